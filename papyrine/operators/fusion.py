"""Rank fusion, score normalisation and boosting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.sparse import top_k

RRF_K = 60
#: Parts of the hybrid score, of the keyword boost and the keyword score from which it counts.
SEMANTIC_PART, KEYWORD_PART, KEYWORD_BOOST, KEYWORD_LEAST = 0.1, 0.9, 0.3, 0.05
SUMMARY_BOOST, SCAFFOLD_BOOST = 0.2, 0.3


def rrf(sparse: DataFrame, dense: DataFrame, k: float = RRF_K, sparse_weight: float = 1.0, dense_weight: float = 1.0, key: str = "doc_id") -> DataFrame:
    """(qid, key, score, sparse_rank, dense_rank): weighted reciprocal ranks over the union of two ranked lists (qid, key, rnk)."""
    s = sparse.select("qid", key, F.col("rnk").alias("sparse_rank"))
    d = dense.select("qid", key, F.col("rnk").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return s.join(d, ["qid", key], "full").select("qid", key, (part(sparse_weight, "sparse_rank") + part(dense_weight, "dense_rank")).alias("score"), "sparse_rank", "dense_rank")


def combine(sparse: DataFrame, dense: DataFrame, top: int = 3, k: float = RRF_K, sparse_weight: float = 0.7, dense_weight: float = 0.3, key: str = "doc_id") -> DataFrame:
    return top_k(rrf(sparse, dense, k, sparse_weight, dense_weight, key), top, key=key)


def sweep(sparse: DataFrame, dense: DataFrame, grid: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rrf`` for each row (k, ws, wb) of a parameter grid, in one job. The grid is a parameter: each candidate carries it as an array."""
    s = sparse.select("qid", key, F.col("rnk").alias("sr"))
    d = dense.select("qid", key, F.col("rnk").alias("dr"))
    cells = F.array(*[F.struct(F.lit(float(r.k)).alias("k"), F.lit(float(r.ws)).alias("ws"), F.lit(float(r.wb)).alias("wb")) for r in grid.toLocalIterator()])
    each = s.join(d, ["qid", key], "full").select("*", F.explode(cells).alias("_g")).select("*", "_g.*")
    part = lambda w, r: F.coalesce(F.col(w) / (F.col("k") + F.col(r)), F.lit(0.0))
    return each.select("k", "ws", "wb", "qid", key, (part("wb", "sr") + part("ws", "dr")).alias("score"))


def hybrid_score(semantic, bm25):
    """Breakdown of the hybrid score: weighted parts of both similarities, at most 1."""
    keyword = F.least(bm25 / 15.0, F.lit(1.0))
    total = F.least(semantic * SEMANTIC_PART + keyword * KEYWORD_PART, F.lit(1.0))
    return F.struct(semantic.alias("semantic"), bm25.alias("bm25"), keyword.alias("keyword"), (semantic * SEMANTIC_PART).alias("semantic_part"), (keyword * KEYWORD_PART).alias("keyword_part"), total.alias("total"))


def keyword_boost(semantic, keyword):
    return F.when(keyword > KEYWORD_LEAST, F.least(semantic + keyword * KEYWORD_BOOST, F.lit(1.0))).otherwise(semantic)


def tier_boost(candidates: DataFrame, summary_ids: DataFrame, scaffold_scores: DataFrame, summary_weight: float = 1.0, scaffold_weight: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Adds ``boosted``: similarity raised for keys among the summary matches (qid, key) and scaffold matches (qid, key, scaffold)."""
    s = summary_ids.select("qid", key).distinct().withColumn("_s", F.lit(1))
    c = scaffold_scores.groupBy("qid", key).agg(F.max("scaffold").alias("_c"))
    raise_by = F.coalesce(F.col("_s") * summary_weight * SUMMARY_BOOST, F.lit(0.0)) + F.coalesce(F.col("_c") * scaffold_weight * SCAFFOLD_BOOST, F.lit(0.0))
    return candidates.join(s, ["qid", key], "left").join(c, ["qid", key], "left").withColumn("boost", raise_by).withColumn("boosted", F.least(F.col("similarity") + F.col("boost"), F.lit(1.0))).drop("_s", "_c")


def min_max(score, group: str = "qid"):
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(F.when(score > 0, 1.0).otherwise(0.0))


def rank_normalised(score, key, group: str = "qid"):
    n = F.count("*").over(Window.partitionBy(group))
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.round(score, 6).desc(), key))
    return F.when(n > 1, 1.0 - (r - 1.0) / (n - 1.0)).otherwise(1.0)


def z_logistic(score, group: str = "qid"):
    w = Window.partitionBy(group)
    sd = F.stddev_pop(score).over(w)
    z = F.when(sd > 1e-12, (score - F.avg(score).over(w)) / sd).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def score_stats(rows: DataFrame, score: str = "score", group: str = "qid") -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"))
