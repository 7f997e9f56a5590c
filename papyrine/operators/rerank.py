"""Re-ranking and merging of candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.fusion import min_max
from papyrine.operators.sparse import top_k

COSINE_PART, BASE_PART = 0.7, 0.3
PARENT_LEAD = 0.1


def local_rerank(candidates: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(…, rerank, rnk): candidates (qid, key, cosine, similarity) by 0.7 cosine + 0.3 first similarity."""
    return top_k(candidates.withColumn("rerank", F.col("cosine") * COSINE_PART + F.col("similarity") * BASE_PART), k, key=key, score="rerank")


def model_rerank(candidates: DataFrame, model, k: int, key: str = "doc_id") -> DataFrame:
    """Candidates by a plugged-in scorer: ``model`` is a function of the query and the text column."""
    return top_k(candidates.withColumn("rerank", model(F.col("query"), F.col("text"))), k, key=key, score="rerank")


def gated(candidates: DataFrame, k: int, enabled: bool = True, key: str = "doc_id") -> DataFrame:
    """The first k by ``rerank`` where a query has at least k candidates, else by ``similarity``."""
    n = F.count("*").over(Window.partitionBy("qid"))
    chosen = F.when((n >= k) & F.lit(enabled), F.col("rerank")).otherwise(F.col("similarity"))
    return top_k(candidates.withColumn("chosen", chosen), k, key=key, score="chosen")


def window_text(window, text):
    """The window around a hit in place of its sentence, where there is one."""
    return F.coalesce(F.nullif(F.trim(window), F.lit("")), text)


def merge_to_parents(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """Leaves (qid, doc_id, similarity, parent_id) replaced by their parent (qid, parent_id, parent_similarity) where that is better by 0.1."""
    j = leaves.join(parents, ["qid", "parent_id"], "left")
    up = F.col("parent_similarity") > F.col("similarity") + PARENT_LEAD
    return j.select("qid", F.when(up, F.col("parent_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(up, F.col("parent_similarity")).otherwise(F.col("similarity")).alias("similarity")).groupBy("qid", "doc_id").agg(F.max("similarity").alias("similarity"))


def half_and_half(windows: DataFrame, merged: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The better half of k from each of two result lists, each at its own scale, without repeats."""
    first = top_k(windows, math.ceil(k / 2), key=key, score="similarity").withColumn("s", min_max(F.col("similarity")))
    second = top_k(merged, k // 2, key=key, score="similarity").withColumn("s", min_max(F.col("similarity")))
    both = first.select("qid", key, "s").unionByName(second.select("qid", key, "s")).groupBy("qid", key).agg(F.max("s").alias("score"))
    return top_k(both, k, key=key)


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k places for each query; places without a result are null."""
    places = queries.select("qid").distinct().withColumn("rnk", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return places.join(results, ["qid", "rnk"], "left")
