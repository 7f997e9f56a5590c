"""Retrieval metrics over ranked runs and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), key: str = "doc_id") -> DataFrame:
    """(qid, k, n_relevant, hits, recall, recall_capped, precision, ndcg, ndcg_exp, mrr) of every judged query.

    ``run`` is (qid, key, rnk), ``qrels`` (qid, key, rel). Both forms of recall (over all
    relevant, and over at most k of them) and of gain (linear, exponential) are given.
    Queries without a relevant document are not judged; those without results score 0.
    """
    rel = qrels.where("rel > 0").groupBy("qid", key).agg(F.max("rel").cast("double").alias("rel"))
    ideal = rel.groupBy("qid").agg(F.count("*").alias("n_relevant"), F.sort_array(F.collect_list("rel"), asc=False).alias("ideal"))
    hits = run.select("qid", key, "rnk").join(rel, ["qid", key]).groupBy("qid").agg(F.collect_list(F.struct("rnk", "rel")).alias("hits"))
    j = ideal.join(hits, "qid", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    none = F.expr("cast(array() as array<struct<rnk:int,rel:double>>)")
    h = F.filter(F.coalesce(F.col("hits").cast("array<struct<rnk:int,rel:double>>"), none), lambda x: x["rnk"] <= F.col("k"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    top = F.slice("ideal", 1, F.col("k"))
    best = F.transform(top, lambda x, i: F.struct((i + 1).alias("rnk"), x.alias("rel")))
    lin, exp = (lambda x: x["rel"] / F.log2(x["rnk"] + 1.0)), (lambda x: (F.pow(F.lit(2.0), x["rel"]) - 1.0) / F.log2(x["rnk"] + 1.0))
    first = F.array_min(F.transform(h, lambda x: x["rnk"]))
    n = F.size(h)
    return j.select(
        "qid", "k", "n_relevant", n.alias("hits"),
        (n / F.col("n_relevant")).alias("recall"), (n / F.least("k", "n_relevant")).alias("recall_capped"), (n / F.col("k")).alias("precision"),
        (total(h, lin) / total(best, lin)).alias("ndcg"), (total(h, exp) / total(best, exp)).alias("ndcg_exp"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
    )


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Averages over the judged queries."""
    names = ["recall", "recall_capped", "precision", "ndcg", "ndcg_exp", "mrr"]
    return metrics.groupBy("k", *by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def ablation(runs: dict[str, DataFrame], qrels: DataFrame, ks: tuple[int, ...] = (10,), key: str = "doc_id") -> DataFrame:
    """Summaries of several runs side by side."""
    out = None
    for mode, run in sorted(runs.items()):
        m = summary(per_query(run, qrels, ks, key)).withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return out


def sweep_recall(scored: DataFrame, qrels: DataFrame, by: list[str], k: int = 10, key: str = "doc_id") -> DataFrame:
    """(by, queries, recall) of each cell of a sweep over (by, qid, key, score): mean recall of the k best over the judged queries."""
    w = Window.partitionBy(*by, "qid").orderBy(F.round("score", 9).desc(), key)
    top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    rel = qrels.where("rel > 0").select("qid", key).distinct()
    n = rel.groupBy("qid").agg(F.count("*").alias("n"))
    hits = top.join(rel, ["qid", key], "left_semi").groupBy(*by, "qid").agg(F.count("*").alias("h"))
    cells = scored.select(*by).distinct().crossJoin(n)
    return cells.join(hits, [*by, "qid"], "left").groupBy(*by).agg(F.count("*").alias("queries"), F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def degradation(full: DataFrame, quantised: DataFrame) -> DataFrame:
    """(mean, sd, least, most, within): drop in recall from one set of per-query metrics to another; within 2 hundredths of the mean."""
    d = full.select("qid", "k", F.col("recall").alias("a")).join(quantised.select("qid", "k", F.col("recall").alias("b")), ["qid", "k"]).withColumn("drop", F.col("a") - F.col("b"))
    m = d.groupBy("k").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("sd"), F.min("drop").alias("least"), F.max("drop").alias("most"))
    return d.join(m, "k").groupBy("k", "mean", "sd", "least", "most").agg(F.avg((F.abs(F.col("drop") - F.col("mean")) <= 0.02).cast("double")).alias("within"))


def containment_qrels(items: DataFrame, documents: DataFrame, words: int = 8, key: str = "doc_id") -> DataFrame:
    """(qid, key, rel): documents that share any run of ``words`` words with an item.

    An equi-join on two 64-bit hashes of the runs, so no run travels as text.
    """
    from papyrine.functions.text import tokens

    def runs(rows: DataFrame, ident: str) -> DataFrame:
        w = rows.select(ident, tokens(F.col("text"), 1).alias("w")).where(F.size("w") >= words)
        g = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda p: F.struct(F.xxhash64(F.slice("w", p, words)).alias("g"), F.xxhash64(F.lit(1), F.slice("w", p, words)).alias("h")))
        return w.select(ident, F.explode(g).alias("x")).select(ident, "x.g", "x.h")

    return runs(documents, key).join(runs(items, "qid"), ["g", "h"]).select("qid", key).distinct().withColumn("rel", F.lit(1))
