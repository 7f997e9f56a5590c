"""Problem 4: near-duplicate texts by banded candidates and sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.shingles import shingle_sets
from papyrine.plans.layout import cut, drop, spread

#: Words of a shingle.
SHINGLE = 5
#: A pair of similarity s shares none of the bands with probability (1 - s**3)**32: 0.014 at 0.5, 0.0004 at 0.6, 3e-10 at 0.8.
BANDS, ROWS = 32, 3
#: Minima compared at a time, and the greatest posterior probability of a true pair at which it may be dropped.
BATCH, MISS = 16, 1e-6
#: Members of one bucket that are paired in one task; larger buckets are cut into blocks of this size.
BLOCK = 256
SIGNATURE = BANDS * ROWS


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, SIGNATURE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Low halves of the 32-bit minima (texts x SIGNATURE) of the given non-empty sets."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SIGNATURE), np.uint16)
    for k, m in enumerate(_multipliers()):
        least = np.minimum.reduceat(((hashes * m) >> np.uint64(32)).astype(np.uint32), starts)
        out[:, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band."""
    b = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), b.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ b[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def stop_table(threshold: float) -> np.ndarray:
    """Least number of agreeing minima after each batch at which a pair stays in the running.

    The prior of the similarity is uniform, so after m agreements in n minima it is
    Beta(m + 1, n - m + 1); a pair is dropped once P(similarity >= threshold) < MISS.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        least = 0
        for m in range(n + 1):
            logp = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logp - logp.max())
            if p[grid >= threshold].sum() / p.sum() >= MISS:
                least = m
                break
        out.append(least)
    return np.array(out)


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))


def _hash_sets(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each whole set."""
    starts = np.cumsum(sizes) - sizes
    a = np.add.reduceat(hashes * np.uint64(0xD1B54A32D192ED03) ^ (hashes >> np.uint64(17)), starts)
    b = np.bitwise_xor.reduceat(hashes * np.uint64(0x8CB92BA72F3D8DD7), starts)
    return a.view(np.int64), (b ^ sizes.astype(np.uint64)).view(np.int64)


def signed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, set_a, set_b, signature): documents with at least one shingle; the fingerprints name equal sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                h, n = shingle_sets(part["text"].tolist(), SHINGLE)
                keep = n > 0
                if keep.any():
                    a, b = _hash_sets(h, n[keep])
                    sig = signatures(h, n[keep])
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[keep], "set_a": a, "set_b": b, "signature": [r.tobytes() for r in sig]})

    return _texts(documents, key, text).mapInPandas(run, "doc_id long, set_a long, set_b long, signature binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), SIGNATURE)
                yield pd.DataFrame({"band": band_keys(sig).ravel(), "rep": np.repeat(pdf["doc_id"].to_numpy(), BANDS)})

    return reps.mapInPandas(run, "band long, rep long")


def _bucket_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by band: pairs of buckets of up to BLOCK members; members of larger ones with a block number.

    A bucket is streamed: no more than one block of it is held. kind 0: a pair (a, b);
    kind 1: member a in block b of a large bucket; kind 2: a large bucket has b blocks.
    """

    def frame(kind, band, a, b):
        return pd.DataFrame({"kind": kind, "band": band, "a": a, "b": b})

    held_band, held, blocks = None, np.zeros(0, np.int64), 0

    def close():
        nonlocal blocks
        if blocks:
            out = frame(np.r_[np.ones(len(held), int), 2], held_band, np.r_[held, 0], np.r_[np.full(len(held), blocks), blocks + 1])
            blocks = 0
            return out
        if len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            return frame(0, held_band, np.minimum(held[i], held[j]), np.maximum(held[i], held[j]))
        return None

    for pdf in batches:
        if not len(pdf):
            continue
        band, rep = pdf["band"].to_numpy(), pdf["rep"].to_numpy()
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        ends = np.r_[starts[1:], len(band)]
        # Only runs of two or more, and those that touch the batch's edges, need a closer look.
        look = (ends - starts > 1) | (starts == 0) | (ends == len(band))
        out = []
        for s, e in zip(starts[look], ends[look]):
            if band[s] != held_band:
                if (x := close()) is not None:
                    out.append(x)
                held_band, held = band[s], np.zeros(0, np.int64)
            held = np.concatenate([held, rep[s:e]])
            while len(held) > BLOCK:
                out.append(frame(1, held_band, held[:BLOCK], blocks))
                held, blocks = held[BLOCK:], blocks + 1
        if out:
            yield pd.concat(out)
    if (x := close()) is not None:
        yield x


def _candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives that share a band, each pair once, written."""
    rows = _bands(reps)
    n = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut(rows.repartition(n, "band").sortWithinPartitions("band").mapInPandas(_bucket_pairs, "kind int, band long, a long, b long"))
    pairs = found.where("kind = 0").select("a", "b")
    blocks = found.where("kind = 2").select("band", F.col("b").alias("blocks"))
    member = found.where("kind = 1").select("band", F.col("a").alias("rep"), F.col("b").alias("block")).join(blocks, "band")
    spot = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spot = spot.groupBy("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("block", "rep")).alias("m"))
    one, two = F.filter("m", lambda x: x["block"] == F.col("i")), F.filter("m", lambda x: x["block"] == F.col("j"))
    crossed = spot.select(F.explode(one).alias("x"), two.alias("ys")).select("x", F.explode("ys").alias("y")).where("x.rep != y.rep").select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    out = cut(pairs.unionByName(crossed).distinct())
    drop(found)
    return out


def _promising(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs that sequential comparison of their signatures does not rule out."""
    stops = stop_table(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["sig_a"]), np.uint16).reshape(len(pdf), SIGNATURE)
            y = np.frombuffer(b"".join(pdf["sig_b"]), np.uint16).reshape(len(pdf), SIGNATURE)
            alive, agree = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for k, least in enumerate(stops):
                part = slice(k * BATCH, (k + 1) * BATCH)
                agree[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[agree[alive] >= least]
            yield pdf.iloc[alive][["a", "b"]]

    sig = reps.select("doc_id", "signature")
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def _exact(pairs: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b, similarity) of the pairs whose whole shingle sets reach the threshold."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                h, n = shingle_sets(part["text"].tolist(), SHINGLE)
                yield pd.DataFrame({"doc_id": part["doc_id"], "shingles": [x.tobytes() for x in np.split(h, np.cumsum(n)[:-1])]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = []
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                sims.append(both / (len(x) + len(y) - both))
            out = pd.DataFrame({"rep_a": pdf["a"], "rep_b": pdf["b"], "similarity": sims})
            yield out[out["similarity"] >= threshold]

    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = documents.join(named, "doc_id", "left_semi").mapInPandas(sets, "doc_id long, shingles binary")
    held = cut(held.dropDuplicates(["doc_id"]))
    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(compare, "rep_a long, rep_b long, similarity double")


def similar_pairs(documents: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (rep, doc_id) are the documents by equal shingle sets under their smallest
    doc_id; ``links`` (rep_a, rep_b, similarity) the pairs of different sets with at least the threshold.

    Candidates share a band of minima. Their signatures are compared a batch at a time
    and a pair is dropped when its posterior probability of reaching the threshold is
    below MISS; survivors are verified on their whole shingle sets. Null ids and texts and
    texts of fewer than SHINGLE words have no shingles and no links. Ids must be unique
    for different texts; repeated rows of one id and text count once.
    """
    signed = cut(signed_documents(documents, key, text))
    members = cut(
        signed.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")).join(signed.select("doc_id", "set_a", "set_b"), ["set_a", "set_b"]).select("rep", "doc_id").distinct()
    )
    # Only the first of equal sets is banded, so a group of copies is one entry of its buckets.
    reps = cut(signed.join(members.where("rep != doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "signature"))
    drop(signed)
    pairs = _candidates(reps)
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = cut(reps.join(named, "doc_id", "left_semi"))
    survivors = cut(_promising(pairs, few, threshold))
    # What is no longer read goes, so the disk holds one step's tables at a time.
    drop(reps, pairs, few)
    links = cut(_exact(survivors, _texts(documents, key, text), threshold))
    drop(survivors)
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity): links and equal sets written out for every two documents."""
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("doc_id").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("doc_id").alias("y"))
    linked = links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "similarity")
    same = members.join(members.withColumnRenamed("doc_id", "y"), "rep").where("doc_id < y").select(F.col("doc_id").alias("doc_id_a"), F.col("y").alias("doc_id_b"), F.lit(1.0).alias("similarity"))
    return linked.unionByName(same)


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, group_id, rep, links): the group of every document with shingles and its representative's links."""
    from papyrine.operators.graph import connected_components

    both = links.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst"))
    degree = both.union(both.select("dst", "src")).groupBy(F.col("src").alias("rep")).agg(F.count("*").alias("links"))
    component = connected_components(both).select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    return members.join(component, "rep", "left").join(degree, "rep", "left").select("doc_id", F.coalesce("group_id", "rep").alias("group_id"), "rep", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
