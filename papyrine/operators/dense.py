"""Dense retrieval: exact and bucketed cosine search, tiers, encoders, quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.operators.graph import bucket_pairs
from papyrine.operators.sparse import top_k
from papyrine.plans.layout import cut
from papyrine.plans.ordered import exact_percentiles

#: Query vectors held by a task at a time; more are searched in blocks.
QUERY_BLOCK = 4096


def norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v):
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a, b):
    """Cosine of two vectors in double; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))


def query_blocks(queries: DataFrame, size: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of a stated set of queries (qid, qvec), QUERY_BLOCK at a time and no more of them in memory."""
    ids, vecs = [], []

    def block() -> tuple[list, np.ndarray]:
        q = np.array(vecs, np.float64)
        n = np.linalg.norm(q, axis=1, keepdims=True)
        return list(ids), np.divide(q, n, out=np.zeros_like(q), where=n > 0)

    for r in queries.select("qid", "qvec").where("qvec is not null").orderBy("qid").toLocalIterator():
        ids.append(r.qid)
        vecs.append(r.qvec)
        if len(ids) == (size or QUERY_BLOCK):
            yield block()
            ids, vecs = [], []
    if ids:
        yield block()


def _best_of(keys: np.ndarray, s: np.ndarray, qids: list, k: int, key: str) -> pd.DataFrame:
    take = min(k, s.shape[1])
    order = np.lexsort((np.broadcast_to(keys, s.shape), -np.round(s, 6)), axis=1)[:, :take]
    best = pd.DataFrame({"qid": np.repeat(qids, take), key: keys[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
    return best[best["score"] > -1.5]


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    m = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, m, out=np.zeros_like(x), where=m > 0)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(qid, key, score, rnk): exact search of a stated set of queries (qid, qvec) over all rows.

    Every task multiplies its rows with a block of queries and passes on its own k best,
    so what is shuffled is k rows per query and batch. The queries come through the driver a block at a time.
    """
    schema = f"qid {dict(queries.dtypes)['qid']}, {key} {dict(vectors.dtypes)[key]}, score double"
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    out = None
    for block in query_blocks(queries):
        held = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qids, q = held.value
            for pdf in batches:
                if len(pdf):
                    keys = pdf["k"].to_numpy()
                    s = q @ _units(pdf["v"]).T
                    if exclude_self:
                        s[np.asarray(qids)[:, None] == keys[None, :]] = -2.0
                    yield _best_of(keys, s, qids, k, key)

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out if out is not None else vectors.sparkSession.createDataFrame([], schema), k, key=key)


def hot_cold(vectors: DataFrame, share: float = 0.2, key: str = "doc_id") -> DataFrame:
    """Adds ``tier``: hot for the first share of the rows by a numeric key (one at least), else cold.

    The border is an exact percentile of the keys, so no task orders all rows. Rows without a key are cold.
    """
    n = vectors.where(F.col(key).isNotNull()).count()
    if not n:
        return vectors.withColumn("tier", F.lit("cold"))
    # Halfway between the last hot key and the next, where keys are numbers.
    place = min(1.0, (max(1, int(n * share)) - 0.5) / max(1, n - 1))
    border = exact_percentiles(vectors, [], key, {"border": place}).first().border
    return vectors.withColumn("tier", F.when(F.col(key) <= F.lit(border), "hot").otherwise("cold"))


def merge_tiers(hot: DataFrame, cold: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Results of both tiers; a key found in both keeps its hot score."""
    both = hot.select("qid", key, "score", F.lit(0).alias("tier")).unionByName(cold.select("qid", key, "score", F.lit(1).alias("tier")))
    once = both.groupBy("qid", key).agg(F.min_by("score", "tier").alias("score"))
    return top_k(once, k, key=key)


def promotions(accesses: DataFrame, least: int = 10, most: int = 50, key: str = "doc_id") -> DataFrame:
    """Keys accessed at least ``least`` times, the most used first, at most ``most``."""
    return accesses.groupBy(key).agg(F.count("*").alias("hits")).where(F.col("hits") >= least).orderBy(F.col("hits").desc(), key).limit(most)


def hashing_encoder(dim: int = 64):
    """Deterministic stand-in for a model: signed feature hashing of words, at unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return encode


def quantise(v, bits: int = 8):
    """Vector as whole numbers of ``bits`` bits and the step between them."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    step = F.when(top > 0, top / (2 ** (bits - 1) - 1)).otherwise(F.lit(1.0))
    return F.struct(F.transform(v, lambda x: F.round(x.cast("double") / step).cast("int")).alias("codes"), step.alias("step"))


def dequantise(q):
    return F.transform(q["codes"], lambda x: x.cast("double") * q["step"])


def _sample(vectors: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` rows (a documented bound of the fit; every row is indexed)."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(most).toPandas()
    if not len(rows):
        return np.zeros((0, 1))
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids_of(x: np.ndarray, k: int, seed: int = 42, rounds: int = 15) -> np.ndarray:
    """Centres of k-means, begun at far-apart points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = [x[rng.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = far.sum()
        c.append(x[rng.choice(len(x), p=far / total)] if total > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    c = np.stack(c)
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c):
            break
        c = new
    return c


def _coded(vectors: DataFrame, vector: str, name: str, books: list[np.ndarray]) -> DataFrame:
    """Adds ``name``: for each code book, in the order of the vector's parts, the nearest code."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def code(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        at = [i for i, x in enumerate(v) if x is not None]
        if at:
            x = np.stack([np.asarray(v.iloc[i], np.float64) for i in at])
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            width = x.shape[1] // len(held.value)
            codes = np.stack([np.argmin((c * c).sum(1) - 2 * x[:, p * width : (p + 1) * width] @ c.T, axis=1) for p, c in enumerate(held.value)], axis=1)
            for i, row in zip(at, codes.tolist()):
                out[i] = row
        return pd.Series(out)

    return vectors.withColumn(name, code(F.col(vector)))


def ivf_lists(vectors: DataFrame, lists: int = 16, key: str = "doc_id", vector: str = "embedding", sample: int = 50_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(vectors with ``bucket``, centroids): inverted lists by k-means on a bounded sample; every row is indexed.

    Fewer than 40 vectors to a list make one list.
    """
    x = _sample(vectors, key, vector, sample)
    lists = max(1, min(lists, len(x) // 40))
    if lists == 1:
        return vectors.withColumn("bucket", F.lit(0)), np.zeros((1, 1))
    c = centroids_of(x, lists, seed)
    return _coded(vectors, vector, "_b", [c]).withColumn("bucket", F.col("_b")[0]).drop("_b"), c


def ivf_search(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 12, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rnk) over the ``probes`` lists nearest to each query.

    The lists' rows stay where they are: a batch is multiplied, list by list, with the queries that probe the list,
    and passes on their k best.
    """
    if len(centroids) == 1:
        return cosine_top_k(indexed, queries, k, key, vector)
    schema = f"qid {dict(queries.dtypes)['qid']}, {key} {dict(indexed.dtypes)[key]}, score double"
    rows = indexed.select(F.col(key).alias("k"), F.col(vector).alias("v"), "bucket").where("v is not null")
    out = None
    unit_centres = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    for qids, q in query_blocks(queries):
        near = np.argsort(-(q @ unit_centres.T), axis=1, kind="stable")[:, :probes]
        held = indexed.sparkSession.sparkContext.broadcast((np.asarray(qids), q, [np.flatnonzero((near == b).any(1)) for b in range(len(centroids))]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qids, q, asking = held.value
            for pdf in batches:
                for b, part in pdf.groupby("bucket"):
                    who = asking[int(b)]
                    if len(who):
                        yield _best_of(part["k"].to_numpy(), q[who] @ _units(part["v"]).T, list(qids[who]), k, key)

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out if out is not None else indexed.sparkSession.createDataFrame([], schema), k, key=key)


def pq_codes(vectors: DataFrame, parts: int = 8, codes: int = 16, key: str = "doc_id", vector: str = "embedding", sample: int = 50_000, seed: int = 42) -> DataFrame:
    """Adds ``pq``: the code of each part of the vector by a k-means of that part; parts divide the dimension."""
    x = _sample(vectors, key, vector, sample)
    while x.shape[1] % parts:
        parts -= 1
    width = x.shape[1] // parts
    return _coded(vectors, vector, "pq", [centroids_of(x[:, p * width : (p + 1) * width], codes, seed + p) for p in range(parts)])


def representatives(vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(rep, id): equal vectors under their smallest id."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.sha2(F.to_json(F.struct(F.col(vector))), 256).alias("h"))
    return v.join(v.groupBy("h").agg(F.min("id").alias("rep")), "h").select("rep", "id")


#: Probability that a pair at the threshold shares no band.
MISSED = 4e-5


def bands_for(threshold: float, n: int) -> tuple[int, int]:
    """(bands, bits): as many bits as keep the chance pairs of n vectors in proportion to n, 14 at least, and the bands they need."""
    bits = max(14, int(n).bit_length())
    agree = (1.0 - np.arccos(threshold) / np.pi) ** bits
    return int(np.ceil(np.log(MISSED) / np.log1p(-agree))), bits


def semantic_edges(vectors: DataFrame, threshold: float = 0.92, k: int | None = 50, key: str = "doc_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """(src, dst, weight), src < dst: pairs of different vectors of one length with at least the threshold, among each other's k best (None: all).

    Candidates share a band of sign bits, of which there are so many that a pair at the threshold is missed with probability
    MISSED. Equal vectors stand under their smallest id (``representatives``), so a group of copies never fills a
    bucket, and large buckets are paired in blocks. Weights are exact.
    """
    reps = representatives(vectors, key, vector).where("rep = id").select("rep")
    v = cut(vectors.select(F.col(key).cast("long").alias("rep"), F.col(vector).alias("v")).join(reps, "rep", "left_semi").dropDuplicates(["rep"]))
    bands, bits = bands_for(threshold, v.count())

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["v"].map(len)):
                if n:
                    x = np.stack(part["v"].to_numpy()).astype(np.float64)
                    g = np.random.default_rng([seed, n]).standard_normal((n, bands * bits))
                    b = (x @ g > 0).reshape(len(x), bands, bits)
                    code = (b << np.arange(bits)).sum(2) + ((np.arange(bands) + bands * n)[None, :] << bits)
                    yield pd.DataFrame({"bucket": code.ravel(), "id": np.repeat(part["rep"].to_numpy(), bands)})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["x"].map(len)):
                w = np.einsum("ij,ij->i", _units(part["x"]), _units(part["y"]))
                keep = np.round(w, 9) >= threshold
                yield pd.DataFrame({"src": part["a"].to_numpy()[keep], "dst": part["b"].to_numpy()[keep], "weight": w[keep]})

    pairs = bucket_pairs(cut(v.mapInPandas(sign, "bucket long, id long")))
    both = pairs.join(v.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b")
    edges = both.where(F.size("x") == F.size("y")).select("a", "b", "x", "y").mapInPandas(weigh, "src long, dst long, weight double")
    if k is None:
        return edges
    edges = cut(edges)
    sides = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(edges.select("dst", "src", "weight"))
    near = sides.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.round("weight", 9).desc(), "b"))).where(F.col("r") <= k)
    return near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight").distinct()
