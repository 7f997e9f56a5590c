"""Problem 5: the most similar vectors for every vector, by a forest of hash prefixes.

Every tree writes a vector as a long string of bits, each the side of a random plane
through the mean of those that share the string so far; a string goes on while more than
LEAF vectors share it, so close vectors get long strings and tight clusters are taken
apart. A tree is the sorted array of its strings. A query descends to its longest
matching prefix in every tree, and all trees then ascend together, one bit at a time,
until the vectors below the query's prefixes number WANTED: the same length of prefix in
all trees, another for each query. Those are its candidates. Where most of what a query
found was found by one tree only, there is more to find, and the trees ascend further.

Trees come in groups that share their first bits, which name the partition a vector is
sent to. The planes' places are medians of a bounded sample there, so partitions are
alike in size whatever the clusters. A vector stands in one partition of each group and
also asks in those PROBES - 1 others that its nearest planes divide it from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.plans.layout import cut

#: Groups of trees and trees of a group.
GROUPS, TREES = 2, 8
#: A partition of a group holds about this many vectors of dimension 64 or less; the shared bits are as many as that takes.
PARTITION = 65_536
#: Partitions of a group that a vector asks in.
PROBES = 3
#: Vectors of one dimension that the shared bits are fitted on (the smallest hashes); every vector is indexed.
SAMPLE = 131_072
#: Bits written at a time, most bits, and vectors that may share a string to its end.
STEP, BITS, LEAF = 8, 64, 16
#: Vectors below a query's prefixes, all trees of a group together, at which it first stops ascending; and how many times as
#: many it takes where it has found less than a share of COVERED of its neighbours, as the agreement of the trees tells.
WANTED, FURTHER, COVERED = 2000, 3, 0.6
#: Equal vectors stand as one; so many of the smallest ids are kept, which is all that k = 10 can use.
K = 10
#: Best candidates that a group passes on, beyond k.
SPARE = 2
SEED = 77
#: Radius of a cluster below which all its cosines are 1 to 12 decimals, so that ids alone decide.
FLAT = 4e-7
#: Scores are cosines of 12 decimals and, below them, the place of an id among at most so many.
UNITS, PLACES = 10**12, 1 << 21


def planes(dim: int, group: int, tree: int, step: int) -> np.ndarray:
    """Directions of the planes of STEP bits; tree 0 stands for the bits that the trees of a group share."""
    return np.random.default_rng([SEED, dim, group, tree, step]).standard_normal((dim, STEP))


# -- rows ----------------------------------------------------------------------------------------


def _mixed(bits: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash of each row of numbers."""
    rng = np.random.default_rng([SEED, salt, bits.shape[1]])
    key, m = (rng.integers(0, 2**63, bits.shape[1], np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    h = (bits.astype(np.uint64) + key) * m
    h ^= h >> np.uint64(29)
    h = (h * m[::-1]).sum(1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of floats as one binary value each."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _usable(dims: tuple[int, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dim = b.column("vector"), b.column("dim").fill_null(-1).to_numpy(zero_copy_only=False)
            start = v.offsets.to_numpy()
            size = np.diff(start)
            values = v.values.to_numpy(zero_copy_only=False)
            ok = v.is_valid().to_numpy(zero_copy_only=False) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & (size == dim) & (dim > 0)
            for d in np.unique(dim[ok]) if dims is None else dims:
                at = np.flatnonzero(ok & (dim == d))
                if not len(at):
                    continue
                x = values[start[at][:, None] + np.arange(d)].astype(np.float32) + np.float32(0)  # no negative zero
                keep = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[keep], x[keep]
                if len(at):
                    bits = x.view(np.uint32)
                    part = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), part.column("at"), pa.array(_mixed(bits, 1)), pa.array(_mixed(bits, 2)), _binary(x)], names=["vec_id", "dim", "at", "ha", "hb", "raw"])

    return run


def usable_vectors(vectors: DataFrame, dims: tuple[int, ...] | None = None) -> DataFrame:
    """(vec_id, dim, ha, hb, raw): one row for each vec_id whose vector is finite, not zero and as long as its dim says.

    Of rows of one vec_id the first stored counts. ``dims`` restricts the dimensions; all are taken otherwise.
    """
    at = F.unix_micros(F.col("stored_at").cast("timestamp")) if "stored_at" in vectors.columns else F.lit(None).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("dim").cast("int").alias("dim"), at.alias("at"), F.col("vector").cast("array<float>").alias("vector"))
    flat = rows.mapInArrow(_usable(dims), "vec_id long, dim int, at long, ha long, hb long, raw binary")
    first = F.min_by(F.struct("dim", "ha", "hb", "raw"), F.struct(F.col("at").isNull(), "at", "ha", "hb"))
    return flat.groupBy("vec_id").agg(first.alias("r")).select("vec_id", "r.*")


def _equal_vectors(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reps (dim, ha, hb, rep, copies), twins (rep, ids)): vectors that are equal float by float under their least id,
    and the K + 1 smallest ids of those that several rows have.

    Two hashes of 64 bits name a vector. A group of equals may hold any share of the rows, so
    its ids are cut to the smallest before and after they come together.
    """
    name = ["dim", "ha", "hb"]
    reps = cut(usable.groupBy(*name).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    several = usable.select("vec_id", *name).join(reps.where("copies > 1"), name).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    w1, w2 = Window.partitionBy("rep", "salt").orderBy("vec_id"), Window.partitionBy("rep").orderBy("vec_id")
    least = several.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= K + 1).withColumn("r", F.row_number().over(w2)).where(F.col("r") <= K + 1)
    return reps, cut(least.groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


# -- partitions of a group -----------------------------------------------------------------------


class Shared:
    """The bits that the trees of a group share: planes by level, and each node's place on them."""

    def __init__(self, dim: int, group: int, depth: int, sample: np.ndarray):
        self.dim, self.group, self.depth = dim, group, depth
        self.places = [np.zeros(1 << j) for j in range(depth)]
        node = np.zeros(len(sample), np.int64)
        for j in range(depth):
            p = sample @ self.plane(j)
            order = np.lexsort((p, node))
            first = np.searchsorted(node[order], np.arange(1 << j))
            size = np.diff(np.r_[first, len(node)])
            some = size > 0
            self.places[j][some] = p[order[first[some] + size[some] // 2]]
            node = node * 2 + (p >= self.places[j][node])

    def plane(self, level: int) -> np.ndarray:
        return planes(self.dim, self.group, 0, level // STEP)[:, level % STEP]

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(vectors x up to ``probes``) partitions, the vector's own first; -1 where there are fewer."""
        n = len(x)
        out = np.full((n, max(1, min(probes, self.depth + 1))), -1, np.int64)
        proj = x @ np.stack([self.plane(j) for j in range(self.depth)], axis=1) if self.depth else np.zeros((n, 0))
        node, margin = np.zeros(n, np.int64), np.zeros((n, self.depth))
        for j in range(self.depth):
            off = proj[:, j] - self.places[j][node]
            margin[:, j] = np.abs(off)
            node = node * 2 + (off >= 0)
        out[:, 0] = node
        near = np.argsort(margin, axis=1, kind="stable")[:, : out.shape[1] - 1]
        for c in range(near.shape[1]):
            node, flip = np.zeros(n, np.int64), near[:, c]
            for j in range(self.depth):
                node = node * 2 + ((proj[:, j] >= self.places[j][node]) ^ (flip == j))
            out[:, c + 1] = node
        return out


# -- the forest of a partition -------------------------------------------------------------------


def strings(x: np.ndarray, member: np.ndarray, dim: int, group: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, flat): each vector's string, padded with zeros, and whether it ended because all who share it have one direction."""
    n = len(x)
    code, flat, live = np.zeros(n, np.uint64), np.zeros(n, bool), np.arange(n)
    for step in range(BITS // STEP):
        if not len(live):
            break
        live = live[np.argsort(code[live], kind="stable")]
        c = code[live]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[start, len(c)])
        members = np.add.reduceat(member[live].astype(np.int64), start)
        go = members > LEAF
        if not go.any():
            break
        live, size, members = live[np.repeat(go, size)], size[go], members[go]
        start = np.cumsum(size) - size
        inside = x[live]
        mean = np.add.reduceat(inside * member[live][:, None], start) / members[:, None]
        inside = inside - np.repeat(mean, size, axis=0)
        one = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", inside, inside) * member[live], start)) < FLAT
        bits = inside @ planes(dim, group, tree, step) > 0
        if one.any():
            rows = np.repeat(one, size)
            flat[live[rows]] = member[live[rows]]
            live, bits = live[~rows], bits[~rows]
        code[live] |= (bits.astype(np.uint64) << np.arange(BITS - 1 - step * STEP, BITS - 1 - step * STEP - STEP, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return code, flat


def shared_bits(code: np.ndarray) -> np.ndarray:
    """Number of leading bits that each of a sorted array of codes has in common with the one before."""
    d = code[1:] ^ code[:-1]
    high, low = (d >> np.uint64(32)).astype(np.float64), (d & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.where(low > 0, np.frexp(low)[1], 0))


class Forest:
    """Sorted arrays of strings over the vectors of a partition; ``guest`` rows only ask."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, guest: np.ndarray, group: int, k: int):
        if len(ids) >= PLACES:
            raise ValueError("too many vectors in one partition")
        order = np.argsort(ids, kind="stable")
        self.ids, self.member = ids[order], ~guest[order]
        x = x[order]
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.keep, self.trees = k + SPARE, []
        n = len(ids)
        for tree in range(1, TREES + 1):
            code, flat = strings(self.unit, self.member, x.shape[1], group, tree)
            at = np.argsort(code, kind="stable")
            bits = shared_bits(code[at])
            # Members before each place of the array, so that a prefix's members are a difference.
            self.trees.append((at, bits, np.r_[0, np.cumsum(self.member[at])], flat))
        self.row, self.score, self.seen = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -2.0)

    def prefixes(self, wanted: int) -> np.ndarray:
        """For each query the longest prefix, the same in all trees, below which at least ``wanted`` vectors stand."""
        n = len(self.ids)
        depth, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        deepest = max((int(bits.max(initial=0)) for _, bits, _, _ in self.trees), default=0)
        for length in range(deepest, 0, -1):
            below = np.zeros(n, np.int64)
            for at, bits, before, _ in self.trees:
                start = np.flatnonzero(np.r_[True, bits < length])
                end = np.r_[start[1:], n]
                below[at] += np.repeat(before[end] - before[start], end - start)
            done = open_ & (below >= wanted)
            depth[done] = length
            open_ &= ~done
            if not open_.any():
                break
        return depth

    def search(self, wanted: int) -> None:
        """All trees ascend until the prefixes hold ``wanted`` vectors, and again where the trees agree too little on what they found."""
        asks, first = np.ones(len(self.ids), bool), True
        while asks.any():
            depth = self.prefixes(wanted)
            self._round(asks, depth, first)
            asks = asks & (depth > 0) & (self._covered() < COVERED)
            wanted, first = wanted * FURTHER, False

    def _round(self, asks: np.ndarray, depth: np.ndarray, first: bool) -> None:
        self.seen[asks[self.row]] = 0
        found_r: list[np.ndarray] = []
        found_s: list[np.ndarray] = []
        for t, (at, bits, before, flat) in enumerate(self.trees):
            its = np.where(asks[at], depth[at], -1)
            for length in np.unique(depth[asks]):
                here = np.flatnonzero(its == length)
                start = np.flatnonzero(np.r_[True, bits < length])
                end = np.r_[start[1:], len(at)]
                node = np.searchsorted(start, here, side="right") - 1
                edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                for lo, hi in zip(edge, np.r_[edge[1:], len(here)]):
                    i = node[lo]
                    columns = at[start[i] : end[i]]
                    columns = columns[self.member[columns]]
                    if flat[columns].all():
                        # One direction: all cosines are equal, so the smallest ids come first.
                        columns = np.sort(columns)[: self.keep + 1]
                    if len(columns):
                        rows, most = at[here[lo:hi]], max(1, 8_000_000 // len(columns))
                        for s in range(0, len(rows), most):
                            self._compare(rows[s : s + most], columns, found_r, found_s, first and t == 0)
            # The least score in hand is raised when it pays: after the first trees and then ever more seldom.
            if t + 1 in (1, 2, 4, 7) or t + 1 == len(self.trees):
                self._settle(found_r, found_s)
                found_r, found_s = [], []

    def _compare(self, rows, columns, found_r, found_s, first: bool) -> None:
        cos = self.unit[rows] @ self.unit[columns].T
        if first and len(columns) > self.keep + 1:
            whole = np.rint(cos * UNITS).astype(np.int64) * PLACES - columns
            j = np.argpartition(whole, len(columns) - self.keep - 1, axis=1)[:, len(columns) - self.keep - 1 :].ravel()
            i = np.repeat(np.arange(len(rows)), self.keep + 1)
        else:
            i, j = np.nonzero(cos > self.least[rows][:, None] - 2e-12)
        r, c = rows[i], columns[j]
        other = r != c
        found_r.append(r[other])
        found_s.append(((UNITS - np.rint(cos[i[other], j[other]] * UNITS)).astype(np.int64) * PLACES) + c[other])

    def _settle(self, found_r, found_s) -> None:
        """Keeps the best different candidates of each query, the smaller id first among equals, and how many trees found each."""
        row, score = np.concatenate([self.row, *found_r]), np.concatenate([self.score, *found_s])
        seen = np.r_[self.seen, np.ones(len(row) - len(self.row), np.int64)]
        if not len(row):
            return
        order = np.argsort(score)
        order = order[np.argsort(row[order], kind="stable")]
        row, score, seen = row[order], score[order], seen[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (score[1:] != score[:-1])])
        row, score, seen = row[new], score[new], np.add.reduceat(seen, new)
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.keep
        self.row, self.score, self.seen, rank = row[best], score[best], seen[best], rank[best]
        last = rank == self.keep - 1
        self.least[self.row[last]] = 1.0 - (self.score[last] // PLACES) / UNITS

    def _covered(self) -> np.ndarray:
        """Share of its neighbours that a query has found, judged by the candidates that only one tree found (Good and Turing)."""
        n = len(self.ids)
        once, all_ = np.bincount(self.row, self.seen == 1, n), np.bincount(self.row, self.seen, n)
        return 1.0 - once / np.maximum(all_, 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, cosine in units of 12 decimals)."""
        return self.ids[self.row], self.ids[self.score % PLACES], UNITS - self.score // PLACES


def search_partition(ids: np.ndarray, x: np.ndarray, group: int, k: int, guest: np.ndarray | None = None, wanted: int = WANTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine in units): the best candidates of every vector of a partition."""
    forest = Forest(ids, x, np.zeros(len(ids), bool) if guest is None else guest, group, k)
    forest.search(wanted)
    return forest.pairs()


# -- the whole -----------------------------------------------------------------------------------


def _sample(usable: DataFrame, dim: int) -> np.ndarray:
    rows = usable.where(F.col("dim") == dim).orderBy("ha", "hb").limit(SAMPLE).select("raw").collect()
    x = np.frombuffer(b"".join(r.raw for r in rows), np.float32).reshape(len(rows), dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, k: int = K, dims: tuple[int, ...] | None = None) -> DataFrame:
    """(vec_id, neighbour, rank, similarity): the k most similar other vectors of the same dim of every usable vector.

    Similarity is the cosine in double, rounded to 12 decimals; equal ones go by the smaller
    id. Rows of one vec_id count once, as first stored. Vectors that are null, zero, not
    finite or of another length than their dim are left out; with fewer than k others, there
    are fewer neighbours. Every dimension is searched unless ``dims`` names some.
    """
    if k > K:
        raise ValueError(f"k is at most {K}")
    usable = cut(usable_vectors(vectors, dims))
    reps, twins = _equal_vectors(usable)
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # Long vectors take more room, so fewer of them share a partition.
    depth = {d: max(0, int(np.ceil(np.log2(n * max(64, d) / 64 / PARTITION)))) for d, n in counts.items()}
    shared = {}
    for d, p in depth.items():
        sample = _sample(usable, d) if p else np.zeros((0, d))
        shared[d] = [Shared(d, g, p, sample) for g in range(GROUPS)]
    held = vectors.sparkSession.sparkContext.broadcast(shared)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim):
                part = b.filter(pa.array(dim == d))
                x = np.frombuffer(b"".join(part.column("raw").to_pylist()), np.float32).reshape(len(part), d).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for g in range(GROUPS):
                    leaves = held.value[int(d)][g].leaves(x, PROBES)
                    for c in range(leaves.shape[1]):
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(np.full(n, g, np.int32)), pa.array(leaves[:, c]), pa.array(np.full(n, c > 0)), part.column("rep"), part.column("raw")], names=["dim", "grp", "leaf", "guest", "rep", "raw"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        d, g = int(pdf["dim"].iloc[0]), int(pdf["grp"].iloc[0])
        x = np.frombuffer(b"".join(pdf["raw"]), np.float32).reshape(len(pdf), d).astype(np.float64)
        a, b, c = search_partition(pdf["rep"].to_numpy(), x, g, k, pdf["guest"].to_numpy())
        return pd.DataFrame({"a": a, "b": b, "units": c})

    rows = usable.select(F.col("vec_id").alias("rep"), "dim", "raw").join(reps.select("rep"), "rep", "left_semi")
    placed = rows.mapInArrow(place, "dim int, grp int, leaf long, guest boolean, rep long, raw binary")
    found = placed.groupBy("dim", "grp", "leaf").applyInPandas(search, "a long, b long, units long")
    # One shuffle brings a query's candidates together; the rest works on that partitioning.
    best = found.repartition("a").groupBy("a", "b").agg(F.max("units").alias("units"))
    near = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("units").desc(), "b"))).where(F.col("r") <= k).drop("r")
    near = near.unionByName(twins.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(UNITS).cast("long").alias("units")))
    options = near.join(twins.withColumnRenamed("rep", "b"), "b", "left").select("a", "units", F.explode(F.coalesce("ids", F.array("b"))).alias("neighbour"))
    # Only the best of a group's options matter to its members: K + 1, as one of them may be the member itself.
    top = options.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("units").desc(), "neighbour"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "units"))).alias("options"))
    member = usable.select("vec_id", "dim", "ha", "hb").join(reps.select("dim", "ha", "hb", F.col("rep").alias("a")), ["dim", "ha", "hb"]).select("a", "vec_id")
    each = member.join(lists, "a").select("vec_id", F.posexplode(F.slice(F.filter("options", lambda o: o["neighbour"] != F.col("vec_id")), 1, k)).alias("rank", "o"))
    return each.select("vec_id", F.col("o.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (F.col("o.units") / float(UNITS)).alias("similarity"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of which at least one is a neighbour of the other."""
    return near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()
