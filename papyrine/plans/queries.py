"""Queries of the core package, one or more for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import stemming, templates, text
from papyrine.operators import catalog, chunking, dedup, dense, evaluate, fusion, logs, rerank, routing, scaffold, sparse
from papyrine.plans.layout import cut, spread, table
from papyrine.plans.ordered import exact_percentiles, rolling_mean
from papyrine.sources import readers, writers

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


# -- inputs that several queries share ---------------------------------------------------------


def _items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _docs(spark, d) -> DataFrame:
    """A single small file would be read by one task; larger tables pass without a shuffle."""
    return spread(table(spark, d, "documents"))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(spark, d) -> DataFrame:
    """Every vector whose id is divisible by 50, searched for in all rows."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _sparse_run(spark, d, k=10) -> DataFrame:
    return sparse.search(_docs(spark, d), _items(spark, d), k)


def _dense_run(spark, d, k=10) -> DataFrame:
    v = _vectors(spark, d)
    q = _items(spark, d).join(v.select(F.col("doc_id").alias("qid"), F.col("embedding").alias("qvec")), "qid").select("qid", "qvec")
    return dense.cosine_top_k(v, q, k).select("qid", "doc_id", "rnk", F.round("score", 6).alias("score"))


def _both(spark, d) -> DataFrame:
    """Candidates of both runs with both scores; 0 where a run does not have them."""
    s = _sparse_run(spark, d).select("qid", "doc_id", F.col("score").alias("bm25"))
    v = _dense_run(spark, d).select("qid", "doc_id", F.col("score").alias("cosine"))
    return s.join(v, ["qid", "doc_id"], "full").select("qid", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def _r(c, n=6):
    return F.round(c, n)


# -- sparse retrieval ---------------------------------------------------------------------------


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse_run(spark, d)


@query
def bm25_joined(spark, d):
    """The same scores from word joins alone, summed over each query's documents."""
    s = sparse.bm25_scores(_docs(spark, d), _items(spark, d))
    return s.groupBy("qid").agg(F.count("*").alias("n"), _r(F.sum("score"), 3).alias("total"), _r(F.max("score")).alias("best"))


@query
def bm25_filtered_lang(spark, d):
    return sparse.search(_docs(spark, d), _items(spark, d), allowed=_docs(spark, d).where("lang = 'en'"))


@query
def bm25_fts_variant(spark, d):
    return sparse.search(_docs(spark, d), _items(spark, d), k1=1.2).drop("sim")


@query
def bm25_fixed_length(spark, d):
    return sparse.search(_docs(spark, d), _items(spark, d), avgdl=1000.0).drop("sim")


@query
def bm25_index_stats(spark, d):
    i = sparse.index_tables(_docs(spark, d))
    postings = i["tf"].agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return i["stats"].crossJoin(postings).crossJoin(i["df"].agg(F.count("*").alias("terms"))).select("n", _r("avgdl", 9).alias("avgdl"), "postings", "tokens", "terms")


@query
def bm25_document_frequency(spark, d):
    return sparse.index_tables(_docs(spark, d))["df"]


@query
def bm25_adhoc_score(spark, d):
    """Each answer against its question, with the corpus statistics of the documents."""
    e = table(spark, d, "evaluations")
    q = sparse.query_terms(e.select(F.col("id").alias("qid"), F.col("question").alias("text")))
    t = e.select("id", text.tokens(F.col("answer")).alias("w")).select("id", F.explode("w").alias("term"), F.size("w").alias("dl")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    i = sparse.index_tables(_docs(spark, d))
    j = q.withColumnRenamed("qid", "id").join(t, ["id", "term"]).join(i["df"], "term", "left").crossJoin(i["stats"])
    df = F.coalesce("df", F.lit(0))
    part = F.col("qf") * F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1.0) * (F.col("tf") * 2.5) / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    return j.groupBy("id").agg(_r(F.sum(part)).alias("score"))


@query
def sparse_dot_topk(spark, d):
    return sparse.search(_docs(spark, d), _items(spark, d), weighting="log").drop("sim")


@query
def sparse_dot_totals(spark, d):
    """Products of sparse vectors as rows, summed for each item."""
    q = sparse.query_terms(_items(spark, d)).select("qid", "term", F.log1p("qf").alias("weight"))
    return sparse.sparse_dot(q, sparse.tf_weights(_docs(spark, d))).groupBy("qid").agg(F.count("*").alias("n"), _r(F.sum("score"), 3).alias("total"))


# -- dense retrieval ----------------------------------------------------------------------------


@query
def dense_topk(spark, d):
    return dense.cosine_top_k(_vectors(spark, d), _vector_queries(spark, d), 10).select("qid", "doc_id", "rnk", _r("score").alias("score"))


@query
def dense_filtered(spark, d):
    return dense.cosine_top_k(_vectors(spark, d).where("label in (1, 2, 3)"), _vector_queries(spark, d), 10).select("qid", "doc_id", "rnk", _r("score").alias("score"))


@query
def ann_hot_cold_merge(spark, d):
    t = dense.hot_cold(_vectors(spark, d))
    q = _vector_queries(spark, d)
    hot, cold = (dense.cosine_top_k(t.where(F.col("tier") == x), q, 10) for x in ("hot", "cold"))
    m = dense.merge_tiers(hot.drop("rnk"), cold.drop("rnk"), 10)
    return m.join(t.select("doc_id", "tier"), "doc_id").select("qid", "doc_id", "rnk", "tier", _r("score").alias("score"))


@query
def ivf_probe(spark, d):
    v, c = dense.ivf_lists(_vectors(spark, d))
    return dense.ivf_search(v, c, _vector_queries(spark, d), 10).select("qid", "doc_id", "rnk", _r("score").alias("score"))


@query
def pq_code_sizes(spark, d):
    return dense.pq_codes(_vectors(spark, d)).groupBy("pq").agg(F.count("*").alias("n"))


@query
def vector_quantised(spark, d):
    v = _vectors(spark, d).withColumn("q", dense.quantise(F.col("embedding")))
    return v.select("doc_id", _r("q.step", 9).alias("step"), F.aggregate("q.codes", F.lit(0), lambda a, x: a + F.abs(x)).alias("weight"))


@query
def vector_norms(spark, d):
    return table(spark, d, "vectors").where("vector is not null").select("vec_id", "stored_at", _r(dense.norm(F.col("vector")), 5).alias("norm")).where("not isnan(norm) and norm < 1e30")


@query
def access_promotions(spark, d):
    return dense.promotions(table(spark, d, "events").select(F.col("user_id").alias("doc_id")))


@query
def encoded_texts(spark, d):
    """Texts of the items by the hashing encoder."""
    e = dense.hashing_encoder(32)
    return _items(spark, d).select("qid", e(F.col("text")).alias("v")).select("qid", _r(dense.norm(F.col("v")), 5).alias("norm"))


# -- fusion, normalisation, boosting -------------------------------------------------------------


@query
def rrf_fuse(spark, d):
    f = fusion.rrf(_sparse_run(spark, d), _dense_run(spark, d), 60, 0.7, 0.3)
    return f.select("qid", "doc_id", _r("score", 9).alias("score"), "sparse_rank", "dense_rank")


@query
def combine_topk(spark, d):
    return fusion.combine(_sparse_run(spark, d), _dense_run(spark, d)).select("qid", "doc_id", "rnk", _r("score", 9).alias("score"))


@query
def rrf_weighted_sweep(spark, d):
    grid = spark.createDataFrame([(float(k), a, b) for k in (20, 60, 100) for a in (0.7, 1.0, 1.3) for b in (0.7, 1.0, 1.3)], "k double, ws double, wb double")
    s = fusion.sweep(_sparse_run(spark, d), _dense_run(spark, d), grid)
    return s.groupBy("k", "ws", "wb").agg(F.count("*").alias("n"), _r(F.sum("score")).alias("total"), _r(F.max("score"), 9).alias("best"))


@query
def hybrid_score_breakdown(spark, d):
    s = _both(spark, d).withColumn("s", fusion.hybrid_score(F.col("cosine"), F.col("bm25")))
    return s.select("qid", "doc_id", *[_r(f"s.{c}", 9).alias(c) for c in ("semantic", "keyword", "semantic_part", "keyword_part", "total")])


@query
def keyword_boost(spark, d):
    return _both(spark, d).select("qid", "doc_id", _r(fusion.keyword_boost(F.col("cosine"), F.least(F.col("bm25") / 15.0, F.lit(1.0)))).alias("boosted"))


@query
def tier_boost(spark, d):
    c = _sparse_run(spark, d).select("qid", "doc_id", F.col("sim").alias("similarity"))
    v = _dense_run(spark, d)
    out = fusion.tier_boost(c, _sparse_run(spark, d, 3), v.select("qid", "doc_id", F.col("score").alias("scaffold")))
    return out.select("qid", "doc_id", _r("boost").alias("boost"), _r("boosted").alias("boosted"))


@query
def norm_minmax(spark, d):
    return _sparse_run(spark, d).select("qid", "doc_id", _r(fusion.min_max(F.col("score"))).alias("norm"))


@query
def norm_rank(spark, d):
    return _sparse_run(spark, d).select("qid", "doc_id", _r(fusion.rank_normalised(F.col("score"), F.col("doc_id"))).alias("norm"))


@query
def norm_zscore(spark, d):
    return _sparse_run(spark, d).select("qid", "doc_id", _r(fusion.z_logistic(F.col("score"))).alias("norm"))


@query
def score_stats(spark, d):
    s = fusion.score_stats(_sparse_run(spark, d))
    return s.select("qid", "n", "least", "most", _r("mean").alias("mean"), _r("sd").alias("sd"))


# -- routing ------------------------------------------------------------------------------------


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "evaluations").select("id", "question")


@query
def route_classify(spark, d):
    return _questions(spark, d).where("question is not null").withColumn("c", routing.classify(F.col("question"))).select("id", "c.label", "c.confidence")


@query
def route_alternative(spark, d):
    return _questions(spark, d).select("id", routing.classify_alternative(F.col("question")).alias("label"))


@query
def route_strategy(spark, d):
    q = _questions(spark, d).withColumn("label", routing.classify_alternative(F.col("question")))
    return q.withColumn("s", routing.strategy(F.col("label"))).select("id", "label", "s.sparse_weight", "s.dense_weight", "s.use_reranker", "s.candidates")


@query
def temporal_filter(spark, d):
    now = F.lit("2025-06-30").cast("date")
    q = _questions(spark, d).withColumn("t", routing.temporal_range(F.col("question"), now)).where("t is not null")
    return q.select("id", F.col("t.start").cast("string").alias("start"), F.col("t.end").cast("string").alias("end"))


@query
def quant_alpha(spark, d):
    g = spark.range(0, 101).select(F.col("id").alias("i"), (F.col("id") / 100.0).alias("a"))
    drop = F.when(F.col("i") % 7 == 0, F.lit(None)).otherwise(F.col("i") / 1000.0)
    alpha = routing.adaptive_alpha(F.col("a"), F.col("i") % 5 != 0, drop, F.lit(1.75))
    w = routing.degraded_weights(F.lit(0.5), F.lit(0.5), F.col("a"))
    return g.select("i", _r(alpha, 9).alias("alpha"), _r(w["sparse_weight"], 9).alias("sparse_weight"), _r(w["dense_weight"], 9).alias("dense_weight"))


# -- re-ranking ---------------------------------------------------------------------------------


@query
def rerank_blend(spark, d):
    c = _both(spark, d).withColumn("similarity", F.least(F.col("bm25") / 15.0, F.lit(1.0)))
    return rerank.local_rerank(c, 5).select("qid", "doc_id", "rnk", _r("rerank").alias("rerank"))


@query
def rerank_gated(spark, d):
    c = _both(spark, d).withColumn("similarity", F.least(F.col("bm25") / 15.0, F.lit(1.0))).withColumn("rerank", F.col("cosine"))
    return rerank.gated(c, 12).select("qid", "doc_id", "rnk", _r("chosen").alias("chosen"))


@query
def auto_merge(spark, d):
    """Hits replaced by their source's best hit where that is clearly better."""
    c = _sparse_run(spark, d).select("qid", "doc_id", F.col("sim").alias("similarity")).withColumn("parent_id", F.floor(F.col("doc_id") / 100).cast("long"))
    p = c.groupBy("qid", "parent_id").agg(F.max("similarity").alias("parent_similarity"))
    return rerank.merge_to_parents(c, p).select("qid", "doc_id", _r("similarity").alias("similarity"))


@query
def half_and_half(spark, d):
    a = _sparse_run(spark, d).select("qid", "doc_id", F.col("sim").alias("similarity"))
    b = _dense_run(spark, d).select("qid", "doc_id", F.col("score").alias("similarity"))
    return rerank.half_and_half(a, b, 7).select("qid", "doc_id", "rnk", _r("score").alias("score"))


@query
def padded_results(spark, d):
    return rerank.padded(_sparse_run(spark, d, 5).select("qid", "rnk", "doc_id"), _items(spark, d), 8).select("qid", "rnk", "doc_id")


# -- chunking -----------------------------------------------------------------------------------


@query
def sentence_window(spark, d):
    s = chunking.sentence_windows(_docs(spark, d))
    return s.select("doc_id", "sentence_index", "window_start", "window_end", F.md5("sentence").alias("sentence_md5"), F.md5("window").alias("window_md5"))


@query
def window_replace(spark, d):
    e = table(spark, d, "evaluations")
    return e.select("id", F.md5(rerank.window_text(F.col("answer"), F.col("question"))).alias("text_md5"))


@query
def char_overlap_chunks(spark, d):
    return chunking.overlap_chunks(_docs(spark, d), 400, 80).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("chunk_md5"))


@query
def adaptive_chunks(spark, d):
    return chunking.overlap_chunks(_docs(spark, d)).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("chunk_md5"))


@query
def table_row_blocks(spark, d):
    c = table(spark, d, "customer").withColumn("i", F.col("c_custkey") - table(spark, d, "customer").agg(F.min("c_custkey")).first()[0])
    return chunking.row_blocks(c, "i", ["c_custkey", "c_name", "c_nationkey"]).select("block", "row_start", "row_end", F.md5("chunk").alias("chunk_md5"))


@query
def multilevel_chunks(spark, d):
    m = chunking.word_level_chunks(_docs(spark, d))
    return m.select("doc_id", "level", "chunk_index", "start_word", "end_word", "chunk_id", F.md5("chunk").alias("chunk_md5"))


@query
def parent_child_join(spark, d):
    return chunking.parents(chunking.word_level_chunks(_docs(spark, d)))


@query
def markdown_headings(spark, d):
    return chunking.markdown_headings(_docs(spark, d))


@query
def structure_nodes(spark, d):
    return chunking.structure_nodes(_docs(spark, d))


@query
def hierarchical_chunks(spark, d):
    return chunking.hierarchical_chunks(_docs(spark, d)).select("doc_id", "chunk_index", "chunk_type", "level", "section_title", "parent_context", "token_count")


@query
def text_formats(spark, d):
    return _docs(spark, d).select("doc_id", chunking.text_format(F.col("text")).alias("format"), text.token_count(F.col("text")).alias("tokens"))


# -- deduplication ------------------------------------------------------------------------------


@query
def exact_dedup(spark, d):
    return dedup.exact_groups(_docs(spark, d)).select("doc_id", "canonical", "copies")


@query
def hash_ids(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query
def minhash_signatures(spark, d):
    s = dedup.minhash(_docs(spark, d))
    return s.select("doc_id", F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("signature_md5"))


@query
def lsh_candidate_pairs(spark, d):
    """Every two different shingle sets that share a band."""
    return dedup.all_candidate_pairs(cut(dedup.minhash(_docs(spark, d)))).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@query
def dedup_pairs(spark, d):
    """Pairs of different shingle sets at 0.8 or more, verified on the whole sets."""
    return dedup.verified_pairs(_docs(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), _r("similarity").alias("similarity"))


@query
def dedup_clusters(spark, d):
    return dedup.verified_groups(_docs(spark, d))


@query
def dedup_stats(spark, d):
    g = dedup.verified_groups(_docs(spark, d)).groupBy("cluster_id").agg(F.count("*").alias("n"))
    return g.groupBy("n").agg(F.count("*").alias("clusters"))


def _usable_vectors(spark, d):
    """One usable vector of each vec_id, each length apart."""
    v = table(spark, d, "vectors").where("vec_id is not null and dim in (64, 32) and size(vector) = dim and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))").where(dense.norm(F.col("vector")) > 0)
    return v.groupBy("vec_id").agg(F.min_by("vector", F.struct("stored_at", "vector")).alias("vector"))


@query
def semantic_edges(spark, d):
    return dense.semantic_edges(_usable_vectors(spark, d), 0.92, None, key="vec_id", vector="vector").select("src", "dst", _r("weight").alias("weight"))


@query
def semantic_clusters(spark, d):
    """Edges, their components, a representative of each by its number of characters in the document, and the map of every vector."""
    v = cut(_usable_vectors(spark, d))
    texts = table(spark, d, "vectors").where("doc_id is not null").groupBy("vec_id").agg(F.min("doc_id").alias("doc_id")).join(_docs(spark, d).select("doc_id", F.char_length("text").cast("double").alias("metric")), "doc_id", "left").select("vec_id", "metric")
    return dedup.semantic_clusters(v, dense.semantic_edges(v, 0.92, None, key="vec_id", vector="vector"), dense.representatives(v, "vec_id", "vector"), texts)


@query
def dedup_results_by_content(spark, d):
    r = _sparse_run(spark, d).select("qid", "doc_id", "rnk")
    return dedup.unique_results(r, _docs(spark, d).select("doc_id", "text")).select("qid", "doc_id", "rnk")


@query
def dedup_results_by_cluster(spark, d):
    """The first result of each content and of each cluster; tens of ids stand for clusters here."""
    r = _sparse_run(spark, d).select("qid", "doc_id", "rnk")
    c = _docs(spark, d).where("doc_id % 7 != 0").select("doc_id", F.floor(F.col("doc_id") / 10).cast("long").alias("cluster_id"))
    return dedup.unique_results(r, _docs(spark, d).select("doc_id", "text"), cluster=c).select("qid", "doc_id", "rnk")


@query
def cluster_representatives(spark, d):
    """The longest document of each source and language."""
    m = _docs(spark, d).where("source is not null").withColumn("cluster", F.concat_ws("/", "source", F.coalesce("lang", F.lit("?"))))
    return dedup.representative_by_metric(m, "cluster", "doc_id", F.char_length("text").cast("double"))


@query
def table_groups(spark, d):
    names = ["region", "nation", "customer", "supplier", "conversations", "messages", "collections"]
    rows = [(n, table(spark, d, n).columns) for n in names]
    return dedup.table_groups(spark.createDataFrame(rows, "name string, columns array<string>")).select("signature", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"))


# -- clusters and scaffolds ---------------------------------------------------------------------


@query
def kmeans_clusters(spark, d):
    return scaffold.kmeans(_vectors(spark, d), 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query
def noise_assigned(spark, d):
    v = _vectors(spark, d).withColumn("cluster", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("label").cast("int")))
    return scaffold.assign_noise(v)


@query
def scaffold_sequential(spark, d):
    """Scaffolds of five documents in a row of each source; the first sentence sums a document up."""
    c = _docs(spark, d).select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), "lang", "text")
    c = scaffold.sequential_groups(c, "source", "doc_id")
    c = c.withColumn("summary", F.try_element_at(text.sentences(F.col("text")), F.lit(1))).withColumn("keywords", F.array(F.coalesce("lang", F.lit("?")))).withColumn("category", F.coalesce("lang", F.lit("?"))).withColumn("n", F.char_length("text"))
    r = scaffold.roll_up(c, ["source", "grp"], "doc_id", "summary", "keywords", "category", "n")
    return r.select("source", "grp", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), F.md5("summary").alias("summary_md5"), F.array_join("keywords", ",").alias("keywords"), "category", "original_size", _r("ratio").alias("ratio"))


@query
def scaffold_expand(spark, d):
    v = _vectors(spark, d).withColumn("scaffold_id", F.floor(F.col("doc_id") / 5).cast("long"))
    s = v.groupBy("scaffold_id").agg(F.min_by("embedding", "doc_id").alias("embedding"), F.array_sort(F.collect_list("doc_id")).alias("chunk_ids"))
    return scaffold.expand(s, _vector_queries(spark, d)).select("qid", "chunk_id", _r("scaffold").alias("scaffold"))


@query
def enriched_chunks(spark, d):
    e = scaffold.enrich(_docs(spark, d).select("doc_id", "text"))
    return e.select("doc_id", F.md5("summary").alias("summary_md5"), F.array_join("keywords", ",").alias("keywords"), "category", _r("score", 4).alias("score"))


# -- evaluation ---------------------------------------------------------------------------------


def _qrels(spark, d) -> DataFrame:
    return evaluate.containment_qrels(_items(spark, d), _docs(spark, d))


METRICS = ("recall", "recall_capped", "precision", "ndcg", "ndcg_exp", "mrr")


@query
def eval_per_query(spark, d):
    m = evaluate.per_query(_sparse_run(spark, d, 20), _qrels(spark, d))
    return m.select("qid", "k", "n_relevant", "hits", *[_r(c).alias(c) for c in METRICS])


@query
def eval_summary(spark, d):
    m = evaluate.summary(evaluate.per_query(_sparse_run(spark, d, 20), _qrels(spark, d)))
    return m.select("k", "queries", *[_r(c).alias(c) for c in METRICS])


@query
def eval_ablation(spark, d):
    s, v = cut(_sparse_run(spark, d)), cut(_dense_run(spark, d))
    m = evaluate.ablation({"bm25": s, "dense": v, "hybrid": fusion.combine(s, v, 10)}, cut(_qrels(spark, d)))
    return m.select("mode", "k", "queries", *[_r(c).alias(c) for c in METRICS])


@query
def eval_degradation(spark, d):
    """Recall of searches with quantised vectors against exact ones, judged by the exact results."""
    v = cut(_vectors(spark, d))
    q = _vector_queries(spark, d)
    exact = cut(dense.cosine_top_k(v, q, 10))
    rough = dense.cosine_top_k(v.withColumn("embedding", dense.dequantise(dense.quantise(F.col("embedding"), 4))), q, 10)
    rel = exact.select("qid", "doc_id", F.lit(1).alias("rel"))
    out = evaluate.degradation(evaluate.per_query(exact, rel, (10,)), evaluate.per_query(rough, rel, (10,)))
    return out.select("k", *[_r(c).alias(c) for c in ("mean", "sd", "least", "most", "within")])


@query
def containment_judgements(spark, d):
    return _qrels(spark, d).select("qid", "doc_id")


# -- telemetry ----------------------------------------------------------------------------------


@query
def latency_percentiles(spark, d):
    p = exact_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *[_r(c).alias(c) for c in ("p50", "p95", "p99")])


@query
def rolling_latency_100(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return rolling_mean(e, ["event_type"], ["ts", "event_id"], "value", 100, "m").select("event_id", "event_type", _r("m", 9).alias("rolling"))


@query
def counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), _r(F.sum("value"), 4).alias("total"))


@query
def cache_hit_rate(spark, d):
    e = table(spark, d, "evaluations")
    return e.groupBy("retrieval_method").agg(F.count("*").alias("n"), F.sum(F.col("has_answer").cast("long")).alias("hits"), _r(F.avg("response_time"), 9).alias("mean_time"))


@query
def semantic_cache_lookup(spark, d):
    v = table(spark, d, "embeddings")
    entries = v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("key"), "embedding", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("vec_id")).alias("stored_at"))
    return catalog.cache_lookup(entries, _vector_queries(spark, d), F.timestamp_seconds(F.lit(1_700_000_000)), 300, 0.2).select("qid", "key", _r("score").alias("score"))


@query
def cache_ttl_lru(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    last = e.agg(F.max("at")).first()[0]
    return catalog.live_entries(e, F.lit(last), 86_400, 50).select("key", F.unix_micros(F.col("last_access").cast("timestamp")).alias("last_us"))


@query
def trace_buffer(spark, d):
    e = table(spark, d, "events")
    return catalog.trace_buffer(e, "user_id", "ts", "event_id", 5, None).select("user_id", "event_id")


# -- catalogue ----------------------------------------------------------------------------------


@query
def collections_count(spark, d):
    return catalog.with_counts(table(spark, d, "collections").select("id", "name"), _docs(spark, d).select("collection_id"))


@query
def chunks_per_source(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query
def semi_fetch(spark, d):
    return catalog.fetch(_docs(spark, d).select("doc_id", "id"), table(spark, d, "vectors").select("doc_id"), "doc_id")


@query
def resume_anti(spark, d):
    return catalog.not_yet(_docs(spark, d).select("doc_id", "id"), table(spark, d, "vectors").select("doc_id"), "doc_id")


@query
def delete_cascade(spark, d):
    m = _docs(spark, d).where("collection_id is not null").select("doc_id", "collection_id")
    gone = m.where("md5(collection_id) < '6' or doc_id % 2 = 0").select("doc_id")
    left, kept = catalog.delete_cascade(m, table(spark, d, "collections"), gone)
    return kept.join(left.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query
def latest_wins(spark, d):
    return catalog.latest_wins(table(spark, d, "messages").where("id is not null").select("id", "role", "received_at"), ["id"], ["received_at", F.coalesce("role", F.lit(""))]).select("id", "role", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


@query
def file_status_counts(spark, d):
    return catalog.status_counts(table(spark, d, "events"), "event_type")


@query
def compaction_steps(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("enqueued_at"))
    return catalog.compaction_steps(e, "event_id").select("event_id", "priority")


@query
def citations(spark, d):
    c = _sparse_run(spark, d).join(_docs(spark, d).select("doc_id", "id", "source", "text", "metadata"), "doc_id")
    return c.select("qid", "rnk", F.col("id").alias("chunk_id"), F.coalesce("source", F.lit("unknown")).alias("source_file"), F.get_json_object("metadata", "$.page").alias("page"), F.substring("text", 1, 200).alias("snippet"), "score")


@query
def audit_export(spark, d):
    a = table(spark, d, "logs_fts").where("component != 'log' and timestamp >= '2025-01-10' and timestamp < '2025-01-12'")
    return a.select("log_id", F.upper("level").alias("level"), "component", text.scrub_log_line(F.col("message")).alias("message"))


@query
def date_range(spark, d):
    return _docs(spark, d).where("created_at >= timestamp'2025-03-01' and created_at < timestamp'2025-04-01'").select("doc_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query
def query_scrub(spark, d):
    return table(spark, d, "evaluations").select("id", text.scrub_query(F.col("question")).alias("question_hash"))


@query
def sanitized_input(spark, d):
    return table(spark, d, "evaluations").select("id", F.md5(text.sanitize_input(F.col("contexts"), 300)).alias("contexts_md5"))


@query
def chat_template(spark, d):
    """Each conversation as one prompt, messages in order of arrival."""
    m = table(spark, d, "messages").where("conversation_id is not null and role is not null and content is not null")
    m = m.groupBy("id").agg(F.min_by(F.struct("conversation_id", "role", "content", "received_at"), F.struct("received_at", "role", "content")).alias("r")).select("id", "r.*")
    row = F.struct("received_at", "id", F.lower(F.trim("role")).alias("role"), "content")
    g = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(row)).alias("ms"))
    prompts = [F.md5(templates.render(F.col("ms"), k)).alias(f"{k}_md5") for k in ("llama3", "mistral", "chatml")]
    return g.select("conversation_id", *prompts, F.size("ms").alias("n"))


@query
def question_contexts(spark, d):
    e = table(spark, d, "evaluations").where("question is not null").select("id", "question", F.from_json("contexts", "array<string>").alias("c"))
    return e.select("id", F.md5(templates.user_message(templates.context_of(F.col("c")), F.col("question"))).alias("message_md5"))


@query
def chunk_id_migration(spark, d):
    c = _docs(spark, d).select("id", "doc_id", "source")
    new = text.chunk_id(F.coalesce("source", F.lit("none")), (F.col("doc_id") % 7).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("doc_id"))
    return catalog.migrate_ids(c, new)[0]


@query
def sanitize_ids(spark, d):
    i = table(spark, d, "logs_fts").select("logfile").distinct()
    return i.select("logfile", text.valid_id(F.col("logfile")).alias("valid"), text.sanitize_id(F.col("logfile")).alias("clean"))


@query
def metadata_values(spark, d):
    """Equality and membership on values of the metadata."""
    m = table(spark, d, "messages").withColumn("client", F.get_json_object("metadata", "$.client"))
    return m.where(F.col("client").isin("cli", "api")).groupBy("client").agg(F.count("*").alias("n"))


@query
def page_of_documents(spark, d):
    return _docs(spark, d).orderBy(F.col("created_at").desc_nulls_last(), "doc_id").offset(40).limit(20).select("doc_id")


@query
def set_operations(spark, d):
    a = _docs(spark, d).select("doc_id")
    b = table(spark, d, "vectors").where("doc_id is not null").select("doc_id")
    both, only = a.intersect(b).withColumn("kind", F.lit("both")), a.subtract(b).withColumn("kind", F.lit("only"))
    return both.unionByName(only).groupBy("kind").agg(F.count("*").alias("n"))


# -- scalar functions ---------------------------------------------------------------------------


@query
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"))


@query
def preprocess_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.preprocess_text(F.col("text"))).alias("plain_md5"))


@query
def tokenize(spark, d):
    t = text.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query
def keyword_parse(spark, d):
    e = table(spark, d, "evaluations").where("answer is not null")
    return e.select("id", F.array_join(text.keyword_list(F.col("answer")), "#").alias("k")).select("id", F.md5("k").alias("keywords_md5"))


@query
def guessed_language(spark, d):
    """By the function words of whole texts."""
    return _docs(spark, d).select("doc_id", text.guess_language(F.col("text"), head=None).alias("language"))


@query
def light_stems(spark, d):
    """How many different stems each document has, by the rules of its guessed language."""
    t = _docs(spark, d).select("doc_id", text.tokens(F.col("text")).alias("w"), text.guess_language(F.col("text"), head=None).alias("k"))
    return t.select("doc_id", F.size(F.array_distinct(stemming.stem_words(F.col("w"), F.col("k")))).alias("stems"))


@query
def german_compound_split(spark, d):
    """Parts of the words of every document that reads as German, whatever its label."""
    t = _docs(spark, d).where(text.guess_language(F.col("text"), head=None) == "de").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("words"), F.md5(F.array_join(stemming.split_compounds(F.col("w")), " ")).alias("parts_md5"))


@query
def sealed_round_trip(spark, d):
    key = F.lit("0123456789abcdef")
    return _items(spark, d).select("qid", (text.decrypt(text.encrypt(F.col("text"), key), key) == F.col("text")).alias("same"))


@query
def smart_sample(spark, d):
    return readers.smart_sample(_docs(spark, d).select("doc_id"), _qrels(spark, d), 500)


@query
def questions_to_corpus(spark, d):
    e = table(spark, d, "evaluations").where("question is not null").select("question", F.from_json("contexts", "array<string>").alias("documents"))
    corpus, queries_, rel = readers.questions_to_corpus(e)
    return corpus.select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id")).unionByName(queries_.select(F.lit("query").alias("part"), F.col("qid").alias("id"))).unionByName(rel.select(F.lit("judgement").alias("part"), F.concat_ws("/", "qid", "doc_id").alias("id")))


@query
def response_lines(spark, d):
    r = _sparse_run(spark, d, 3)
    line = writers.response_lines(r.select("qid", "rnk", "doc_id", "score"))
    get = lambda f, t: F.get_json_object("line", f"$.{f}").cast(t).alias(f)
    return line.select("qid", "seq", get("type", "string"), get("doc_id", "long"), get("score", "double"), get("n", "long"))


# -- log entries --------------------------------------------------------------------------------


@query
def p7_found(spark, d):
    return logs.log_entries(table(spark, d, "logs_fts"), with_message=False)


@query
def p7_entries(spark, d):
    """The entries with their whole messages."""
    return logs.log_entries(table(spark, d, "logs_fts"))


def queries() -> dict:
    return dict(REGISTRY)
