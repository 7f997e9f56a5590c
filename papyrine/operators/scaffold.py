"""Clusters and scaffolds: summary groups over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.dense import cosine_top_k, unit
from papyrine.plans.ordered import by_range, running_sum

GROUP = 5
SUMMARY_PARTS, SUMMARY_CHARS, KEYWORDS = 3, 500, 10


def kmeans(vectors: DataFrame, k: int | None = None, most: int = 10, key: str = "doc_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(key, cluster): k-means on unit vectors; without ``k`` the number of best silhouette up to ``most``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    f = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(unit(F.col(vector))).alias("features"))
    best, best_score = None, float("-inf")
    for n in [k] if k else range(2, most + 1):
        out = KMeans(k=n, seed=seed, maxIter=10).fit(f).transform(f)
        score = 0.0 if k else ClusteringEvaluator().evaluate(out)
        if score > best_score:
            best, best_score = out, score
    return best.select(key, F.col("prediction").alias("cluster"))


def assign_noise(clustered: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster): members of cluster -1 go to the cluster whose centre is nearest."""
    from papyrine.operators.dense import cosine

    dims = F.posexplode(unit(F.col(vector))).alias("i", "x")
    centre = clustered.where("cluster >= 0").select("cluster", dims).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    # There are as many centres as clusters, a parameter of the clustering.
    centres = centre.agg(F.collect_list(F.struct("cluster", "centre")).alias("centres"))
    near = F.array_max(F.transform("centres", lambda c: F.struct(cosine(F.col(vector), c["centre"]).alias("s"), (-c["cluster"]).alias("c"))))
    return clustered.crossJoin(centres).select(key, F.when(F.col("cluster") >= 0, F.col("cluster")).otherwise(-near["c"]).alias("cluster"))


def sequential_groups(chunks: DataFrame, within: str, order: str, size: int = GROUP) -> DataFrame:
    """Adds ``grp``: groups of ``size`` consecutive chunks of each ``within``, which must not be null.

    A source of any size is numbered in ranges, with what stands before a range carried over. ``order`` must tell all rows apart.
    """
    i = running_sum(by_range(chunks, [within], [order]), [within], "chunk", [order], F.lit(1), "_i")
    return i.withColumn("grp", F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i", "chunk")


def roll_up(chunks: DataFrame, by: list[str], key: str, summary: str, keywords: str, category: str, size: str) -> DataFrame:
    """Scaffolds: the first summaries, distinct keywords, the commonest category, chunk ids and sizes of each group."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(summary).alias("s"), F.col(keywords).alias("w"))))
    counts = chunks.groupBy(*by, F.col(category).alias("_c")).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("category"))
    g = chunks.groupBy(*by).agg(rows.alias("r"), F.sum(size).alias("original_size"))
    text = F.substring(F.array_join(F.slice(F.filter(F.transform("r", lambda x: x["s"]), lambda s: s.isNotNull()), 1, SUMMARY_PARTS), " "), 1, SUMMARY_CHARS)
    words = F.slice(F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["w"], F.array().cast("array<string>"))))), 1, KEYWORDS)
    out = g.select(*by, F.transform("r", lambda x: x["k"]).alias("chunk_ids"), text.alias("summary"), words.alias("keywords"), "original_size").join(counts, by, "left")
    ident = F.concat(F.lit("scaffold_"), F.substring(F.md5(F.concat_ws("_", F.lit("scaffold"), *[F.col(b).cast("string") for b in by], F.substring("summary", 1, 50))), 1, 12))
    return out.withColumn("ratio", F.char_length("summary") / F.greatest(F.col("original_size"), F.lit(1))).withColumn("scaffold_id", ident)


def expand(scaffolds: DataFrame, queries: DataFrame, k: int = 5, key: str = "scaffold_id") -> DataFrame:
    """(qid, chunk_id, scaffold): chunks of the k nearest scaffolds (key, embedding, chunk_ids) at 1 / (1 + distance)."""
    near = cosine_top_k(scaffolds, queries, k, key=key)
    return near.join(scaffolds.select(key, "chunk_ids"), key).select("qid", F.explode("chunk_ids").alias("chunk_id"), (1.0 / (2.0 - F.col("score"))).alias("s")).groupBy("qid", "chunk_id").agg(F.max("s").alias("scaffold"))


def enrich(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds summary (first sentence), keywords (five longest different words), category and a score in [0, 5]: extractive defaults for a model."""
    from papyrine.functions.text import sentences, tokens

    words = F.array_distinct(tokens(F.col(text), 5))
    five = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 5)
    n = F.size(tokens(F.col(text), 1))
    return chunks.withColumn("summary", F.try_element_at(sentences(F.col(text)), F.lit(1))).withColumn("keywords", five).withColumn("category", F.when(n < 100, "short").when(n < 400, "medium").otherwise("long")).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(5.0), n / 100.0)))
