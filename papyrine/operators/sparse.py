"""BM25 over all documents for a batch of queries, and sparse vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import tokens
from papyrine.plans.layout import cut, spread

K1, B = 1.5, 0.75
#: Score at which the similarity reaches 1.
FULL_SCORE = 15.0
#: Queries scored at a time at most, and cells of the matrix of a block's words by its queries (8 bytes each): the bound of what is broadcast.
QUERY_BLOCK, CELLS = 1024, 4_000_000
#: Tasks for each core that sum over all documents.
SUMMING = 2
_WORDS = re.compile(r"\w{2,}")


def tokenised(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return rows.select(F.col(key), tokens(F.col(text)).alias("terms"))


def index_tables(documents: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """The index as tables: tf (key, term, tf), df (term, df), dl (key, dl), stats (n, avgdl).

    Documents without words have no row in tf and dl and do not count for n.
    """
    t = tokenised(documents, key, text)
    tf = t.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    dl = t.select(key, F.size("terms").cast("long").alias("dl")).where("dl > 0")
    return {"tf": tf, "dl": dl, "df": tf.groupBy("term").agg(F.count("*").alias("df")), "stats": dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))}


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, term, qf): repeated words count as often as they stand."""
    return tokenised(queries, qid, text).select(F.col(qid).alias("qid"), F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))


def bm25_scores(documents: DataFrame, queries: DataFrame, key: str = "doc_id", qid: str = "qid", k1: float = K1, b: float = B, avgdl: float | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, key, score) of every document that shares a word with a query.

    Only words of the queries are counted: a document is one row with its length until
    its words have been filtered, so the shuffle holds matches and not the corpus. The
    statistics stay those of all documents where ``allowed`` (keys) restricts the result.
    """
    q = query_terms(queries, qid)
    t = tokenised(documents, key).select(key, "terms", F.size("terms").cast("long").alias("dl")).where("dl > 0")
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl") if avgdl is None else F.lit(float(avgdl)).alias("avgdl"))
    tf = t.select(key, "dl", F.explode("terms").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    kept = tf if allowed is None else tf.join(allowed.select(key).distinct(), key, "left_semi")
    weighted = q.join(df, "term").crossJoin(stats).select("qid", "term", "avgdl", (F.col("qf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).alias("w"))
    part = F.col("w") * (F.col("tf") * (k1 + 1.0)) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return kept.join(weighted, "term").groupBy("qid", key).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score", group: str = "qid", rank: str = "rnk") -> DataFrame:
    """The k best rows of each group with their rank; ties at six decimals go by key."""
    w = Window.partitionBy(group).orderBy(F.round(score, 6).desc(), F.col(key))
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def similarity(score):
    """Scores as similarities of at most 1."""
    return F.least(score / FULL_SCORE, F.lit(1.0))


def _encoded(documents: DataFrame, vocabulary: dict[str, int], key: str, text: str) -> DataFrame:
    """(key, dl, ids, tfs): each document's length and its words that the queries hold, as numbers."""
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                words = _WORDS.findall(t.lower())
                if words:
                    counted = Counter(map(get, words))
                    counted.pop(None, None)
                    out.append((k, len(words), np.fromiter(counted.keys(), np.int32, len(counted)).tobytes(), np.fromiter(counted.values(), np.int32, len(counted)).tobytes()))
            yield pd.DataFrame(out, columns=[key, "dl", "ids", "tfs"])

    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null"))
    return cut(rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, dl long, ids binary, tfs binary"))


def _statistics(encoded: DataFrame, size: int) -> tuple[int, float, np.ndarray]:
    """(documents, average length, document frequency of each query word): one row per word and task is summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(size, np.int64), 0, 0
        for pdf in batches:
            df += np.bincount(np.frombuffer(b"".join(pdf["ids"]), np.int32), minlength=size)
            n, total = n + len(pdf), total + int(pdf["dl"].sum())
        yield pd.DataFrame({"i": np.r_[np.arange(size), -1, -2], "x": np.r_[df, n, total]})

    few = encoded.coalesce(SUMMING * encoded.sparkSession.sparkContext.defaultParallelism)
    x = {r.i: r.x for r in few.mapInPandas(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    n = x.get(-1, 0)
    return n, x.get(-2, 0) / n if n else 0.0, np.array([x.get(i, 0) for i in range(size)], np.float64)


def search(documents: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, avgdl: float | None = None, allowed: DataFrame | None = None, weighting: str = "bm25") -> DataFrame:
    """(qid, key, rnk, score, sim): the k best of all documents for each of a stated set of queries, positive scores only.

    The result is that of ``bm25_scores``. Documents are scored in batches against blocks
    of queries, as products of a batch's words with the queries' weights, and a batch
    passes on no more than k rows of each query; joining words to words would ship one
    row for every word that a query and a document share.
    """
    spark = documents.sparkSession
    qtype, ktype = dict(queries.dtypes)["qid"], dict(documents.dtypes)[key]
    asked = query_terms(queries).orderBy("qid", "term").toLocalIterator()
    vocabulary: dict[str, int] = {}
    per: dict = {}
    for r in asked:
        per.setdefault(r.qid, []).append((vocabulary.setdefault(r.term, len(vocabulary)), r.qf))
    schema = f"qid {qtype}, {key} {ktype}, score double"
    if not vocabulary:
        return _ranked(spark.createDataFrame([], schema), k, key)
    encoded = _encoded(documents, vocabulary, key, text)
    n, mean, df = _statistics(encoded, len(vocabulary))
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
    mean = mean if avgdl is None else float(avgdl)
    rows = encoded if allowed is None else encoded.join(allowed.select(key).distinct(), key, "left_semi")
    out = None
    for part in _blocks(per):
        # Only the block's own words have a row, so its matrix has a bound whatever the vocabulary.
        own = np.unique(np.array([t for q in part for t, _ in per[q]], np.int64))
        weights = np.zeros((len(own), len(part)))
        for j, q in enumerate(part):
            for t, qf in per[q]:
                weights[np.searchsorted(own, t), j] = qf * idf[t] if weighting == "bm25" else np.log1p(qf)
        held = spark.sparkContext.broadcast((part, own, weights, mean))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            part, own, weights, mean = held.value
            step = max(50, CELLS // len(weights))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    p = pdf.iloc[at : at + step]
                    sizes = np.array([len(x) // 4 for x in p["ids"]])
                    if not sizes.sum():
                        continue
                    t, tf = np.frombuffer(b"".join(p["ids"]), np.int32), np.frombuffer(b"".join(p["tfs"]), np.int32)
                    rows_ = np.repeat(np.arange(len(p)), sizes)
                    place = np.minimum(np.searchsorted(own, t), len(own) - 1)
                    known = own[place] == t
                    place, tf, rows_ = place[known], tf[known], rows_[known]
                    dl = p["dl"].to_numpy()[rows_]
                    w = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / mean)) if weighting == "bm25" else np.log1p(tf)
                    dense = np.zeros((len(p), len(weights)))
                    dense[rows_, place] = w
                    s = (dense @ weights).T
                    keys = p[key].to_numpy()
                    take = min(k, s.shape[1])
                    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(keys)), s.shape), -np.round(s, 6)), axis=1)[:, :take]
                    best = pd.DataFrame({"qid": np.repeat(part, take), key: keys[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                    yield best[best["score"] > 0]

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k, key)


def _blocks(per: dict) -> Iterator[list]:
    """Queries in blocks whose words times queries stay within CELLS."""
    part: list = []
    words: set = set()
    for q, terms in per.items():
        more = {t for t, _ in terms}
        if part and (len(part) == QUERY_BLOCK or len(words | more) * (len(part) + 1) > CELLS):
            yield part
            part, words = [], set()
        part.append(q)
        words |= more
    if part:
        yield part


def _ranked(scores: DataFrame, k: int, key: str) -> DataFrame:
    found = top_k(scores, k, key=key)
    return found.select("qid", key, F.col("rnk").cast("int").alias("rnk"), F.round("score", 6).alias("score"), F.round(similarity(F.col("score")), 6).alias("sim"))


def sparse_dot(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of sparse vectors given as rows (qid or doc_id, term, weight)."""
    q = queries.select("qid", "term", F.col("weight").alias("qw"))
    return documents.join(q, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def tf_weights(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, weight = ln(1 + tf)): the sparse encoder used where no model is plugged in."""
    return index_tables(documents, key, text)["tf"].select(key, "term", F.log1p("tf").alias("weight"))
