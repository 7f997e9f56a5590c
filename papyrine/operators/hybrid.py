"""From questions to ranked, cited answers in one plan: routing, both searches, fusion, re-ranking, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import dense, fusion, rerank, routing, sparse

#: Candidates for each result wanted, where windows are put in the place of sentences.
WIDER = 5


def initial_candidates(k: int, windows: bool) -> int:
    """Candidates that a search brings to the ranking: more where windows may fall together."""
    return k * WIDER if windows else k


def annotate(candidates: DataFrame, score: str) -> DataFrame:
    """Adds ``raw``, ``normalised`` (0 to 1 within the query) and ``found_by`` (both, bm25 or dense) to candidates with both ranks."""
    found_by = F.when(F.col("sparse_rank").isNotNull() & F.col("dense_rank").isNotNull(), "both").when(F.col("sparse_rank").isNotNull(), "bm25").otherwise("dense")
    return candidates.withColumns({"raw": F.col(score), "normalised": fusion.min_max(F.col(score)), "found_by": found_by})


def ranked(documents: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 10, windows: bool = False, rrf_k: float = fusion.RRF_K) -> DataFrame:
    """(qid, doc_id, rnk, label, found_by, raw, normalised, score) of a stated set of questions (qid, text, qvec).

    Each question is classified and gets the weights of its class; BM25 and cosine candidates are
    fused by weighted reciprocal ranks. Where the class asks for it and there are at least k
    candidates, the first are ordered by cosine and fused score together. Questions without a vector have BM25 candidates only.
    """
    n = initial_candidates(k, windows)
    label = routing.classify_alternative(F.col("text"))
    plan = questions.select("qid", label.alias("label")).withColumn("s", routing.strategy(F.col("label"))).select("qid", "label", "s.sparse_weight", "s.dense_weight", "s.use_reranker")
    by_words = sparse.search(documents, questions.select("qid", "text"), n).select("qid", "doc_id", F.col("rnk").alias("sparse_rank"))
    by_vector = dense.cosine_top_k(vectors, questions.select("qid", "qvec"), n).select("qid", "doc_id", F.col("rnk").alias("dense_rank"), F.round("score", 6).alias("cosine"))
    both = by_words.join(by_vector, ["qid", "doc_id"], "full").join(plan, "qid")
    part = lambda w, r: F.coalesce(F.col(w) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    fused = annotate(both.withColumn("score", part("sparse_weight", "sparse_rank") + part("dense_weight", "dense_rank")), "score")
    enough = F.count("*").over(Window.partitionBy("qid")) >= k
    blended = rerank.COSINE_PART * F.coalesce("cosine", F.lit(0.0)) + rerank.BASE_PART * F.col("normalised")
    final = fused.withColumn("final", F.when(F.col("use_reranker") & enough, blended).otherwise(F.col("normalised")))
    return sparse.top_k(final, k, score="final").select("qid", "doc_id", "rnk", "label", "found_by", "raw", "normalised", F.col("final").alias("score"))


def cited(results: DataFrame, documents: DataFrame, snippet: int = 200) -> DataFrame:
    """Results with what a citation needs: chunk id, file, page and the beginning of the text."""
    d = documents.select("doc_id", F.col("id").alias("chunk_id"), F.coalesce("source", F.lit("unknown")).alias("source_file"), F.get_json_object("metadata", "$.page").alias("page"), F.substring("text", 1, snippet).alias("snippet"))
    return results.join(d, "doc_id")


def labelled(questions: DataFrame, cache: DataFrame, now, ttl_s: int = 300, least: float = 0.7, model=None) -> DataFrame:
    """(qid, label, origin): a fresh cached label, else that of the patterns if they are sure enough, else that of ``model`` (a function of the text column).

    ``cache`` is (text, label, stored_at); the latest entry of a text counts. Without a model the other pattern set decides.
    """
    fresh = cache.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= ttl_s).groupBy("text").agg(F.max_by("label", F.struct("stored_at", "label")).alias("cached"))
    c = questions.withColumn("c", routing.classify(F.col("text"))).join(fresh, "text", "left")
    guess = (model or routing.classify_alternative)(F.col("text"))
    sure = F.col("c.confidence") >= least
    origin = F.when(F.col("cached").isNotNull(), "cache").when(sure, "patterns").otherwise("model")
    return c.select("qid", F.coalesce("cached", F.when(sure, F.col("c.label")), guess).alias("label"), origin.alias("origin"))
