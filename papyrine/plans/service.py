"""Queries of what a service keeps and composes: answers, state logs, saved tables, vector indexes; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papyrine.operators import dedup, evaluate, fusion, hybrid, state, vector_index
from papyrine.operators import sparse as sparse_ops
from papyrine.plans import oracle
from papyrine.plans.layout import shared_dir, table
from papyrine.plans.queries import _dense_run, _docs, _items, _qrels, _r, _sparse_run, _vector_queries, _vectors
from papyrine.sources import readers, writers

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        REGISTRY[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"


# -- answers -------------------------------------------------------------------------------------


def _questions(spark, d):
    v = _vectors(spark, d).select(F.col("doc_id").alias("qid"), F.col("embedding").alias("qvec"))
    return _items(spark, d).join(v, "qid")


_LABEL = oracle._ALT.replace("question", "text")
_RANKED = f"""{oracle.FUSED}, la AS (SELECT item_id AS qid, {_LABEL} AS label FROM benchmark),
    we AS (SELECT qid, label, CASE label WHEN 'factual' THEN 0.6::DOUBLE WHEN 'conceptual' THEN 0.2::DOUBLE WHEN 'temporal' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS ws,
        CASE label WHEN 'factual' THEN 0.4::DOUBLE WHEN 'conceptual' THEN 0.8::DOUBLE WHEN 'temporal' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS wd FROM la),
    fu AS (SELECT qid, doc_id, label, coalesce(ws / (60.0::DOUBLE + s.rnk), 0.0::DOUBLE) + coalesce(wd / (60.0::DOUBLE + d.rnk), 0.0::DOUBLE) AS raw, coalesce(d.score, 0.0) AS cosine,
        CASE WHEN s.rnk IS NOT NULL AND d.rnk IS NOT NULL THEN 'both' WHEN s.rnk IS NOT NULL THEN 'bm25' ELSE 'dense' END AS found_by FROM sp s FULL JOIN dn d USING (qid, doc_id) JOIN we USING (qid)),
    nm AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) WHEN raw > 0 THEN 1.0 ELSE 0.0 END AS normalised, count(*) OVER w AS n FROM fu WINDOW w AS (PARTITION BY qid)),
    fi AS (SELECT *, CASE WHEN label IN ('conceptual', 'comparative') AND n >= 10 THEN 0.7::DOUBLE * cosine + 0.3::DOUBLE * normalised ELSE normalised END AS f FROM nm),
    an AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, doc_id) AS INTEGER) AS rnk FROM fi) WHERE rnk <= 10)"""


@query(f"{_RANKED} SELECT qid, doc_id, rnk, label, found_by, round(raw, 9) AS raw, round(normalised, 6) AS normalised, round(f, 6) AS score FROM an")
def hybrid_answers(spark, d):
    r = hybrid.ranked(_docs(spark, d), _vectors(spark, d), _questions(spark, d), 10)
    return r.select("qid", "doc_id", "rnk", "label", "found_by", _r("raw", 9).alias("raw"), _r("normalised").alias("normalised"), _r("score").alias("score"))


@query(f"""{_RANKED} SELECT qid, rnk, id AS chunk_id, coalesce(source, 'unknown') AS source_file, json_extract_string(metadata, '$.page') AS page, substr(text, 1, 200) AS snippet FROM an JOIN documents USING (doc_id)""")
def hybrid_citations(spark, d):
    r = hybrid.ranked(_docs(spark, d), _vectors(spark, d), _questions(spark, d), 10)
    return hybrid.cited(r, _docs(spark, d)).select("qid", "rnk", "chunk_id", "source_file", "page", "snippet")


_ROUTE = oracle.oracle_sql()["route_classify"]


@query(f"""WITH rc AS ({_ROUTE}), ca AS (SELECT question AS text, arg_max(model_used, stored_at) AS cached FROM evaluations WHERE id % 3 = 0 AND question IS NOT NULL AND model_used IS NOT NULL
        AND epoch_us(stored_at) // 1000000 >= (SELECT max(epoch_us(stored_at)) // 1000000 - 864000 FROM evaluations) GROUP BY question)
    SELECT e.id AS qid, coalesce(cached, CASE WHEN rc.confidence >= 0.7 THEN rc.label ELSE {oracle._ALT} END) AS label, CASE WHEN cached IS NOT NULL THEN 'cache' WHEN rc.confidence >= 0.7 THEN 'patterns' ELSE 'model' END AS origin
    FROM evaluations e JOIN rc USING (id) LEFT JOIN ca ON ca.text = e.question""")
def classified_questions(spark, d):
    """Labels from a cache of ten days, the patterns or the stand-in for a model."""
    e = table(spark, d, "evaluations").where("question is not null")
    now = F.lit(table(spark, d, "evaluations").agg(F.max("stored_at")).first()[0])
    cache = e.where("id % 3 = 0 and model_used is not null").select(F.col("question").alias("text"), F.col("model_used").alias("label"), "stored_at")
    return hybrid.labelled(e.select(F.col("id").alias("qid"), F.col("question").alias("text")), cache, now, 864_000)


@query(f"""{oracle.FUSED}, {oracle._QRELS}, g AS (SELECT CAST(k AS DOUBLE) AS k, CAST(ws AS DOUBLE) AS ws, CAST(wb AS DOUBLE) AS wb FROM (SELECT unnest([20, 60, 100]) AS k) CROSS JOIN (SELECT unnest([0.7, 1.0, 1.3]) AS ws) CROSS JOIN (SELECT unnest([0.7, 1.0, 1.3]) AS wb)),
    x AS (SELECT k, ws, wb, qid, doc_id, coalesce(wb / (k + s.rnk), 0.0) + coalesce(ws / (k + d.rnk), 0.0) AS score FROM sp s FULL JOIN dn d USING (qid, doc_id) CROSS JOIN g),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, ws, wb, qid ORDER BY round(score, 9) DESC, doc_id) AS r FROM x) WHERE r <= 10),
    n AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid), h AS (SELECT k, ws, wb, qid, count(*) AS h FROM t JOIN qrels USING (qid, doc_id) GROUP BY ALL)
    SELECT k, ws, wb, count(*) AS queries, round(avg(coalesce(h, 0) / n.n::DOUBLE), 6) AS recall FROM g CROSS JOIN n LEFT JOIN h USING (k, ws, wb, qid) GROUP BY k, ws, wb""")
def rrf_sweep_recall(spark, d):
    """Recall at 10 of every cell of the fusion's parameter grid."""
    grid = spark.createDataFrame([(float(k), a, b) for k in (20, 60, 100) for a in (0.7, 1.0, 1.3) for b in (0.7, 1.0, 1.3)], "k double, ws double, wb double")
    m = evaluate.sweep_recall(fusion.sweep(_sparse_run(spark, d), _dense_run(spark, d), grid), _qrels(spark, d), ["k", "ws", "wb"])
    return m.select("k", "ws", "wb", "queries", _r("recall").alias("recall"))


# -- state ---------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"


def _file_events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("file_path"), F.expr(_STATUS).alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"""SELECT file_path, arg_max(status, (tm, seq)) AS status, sum(CASE WHEN status = 'processing' THEN 1 ELSE 0 END)::BIGINT AS attempts, epoch_us(min(tm)) AS first_us, epoch_us(max(tm)) AS updated_us
    FROM (SELECT user_id AS file_path, {_STATUS} AS status, ts AS tm, event_id AS seq FROM events) GROUP BY file_path""")
def ingestion_states(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return state.ingestion_states(_file_events(spark, d)).select("file_path", "status", "attempts", us("first_at").alias("first_us"), us("updated_at").alias("updated_us"))


@query(f"""SELECT run_id, status, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS run_id, {_STATUS} AS status FROM events) WHERE run_id = (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) GROUP BY run_id, status""")
def latest_run_counts(spark, d):
    e = _file_events(spark, d).withColumn("started_at", F.date_trunc("day", "at")).withColumn("run_id", F.date_format("at", "yyyy-MM-dd"))
    return state.latest_run(e)


@query("""WITH ch AS (SELECT collection_id AS id, CASE doc_id % 97 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END AS op, source AS name, CASE WHEN doc_id % 5 = 0 THEN lang END AS color, (coalesce(created_at, ingested_at), doc_id) AS o FROM documents WHERE collection_id IS NOT NULL),
    g AS (SELECT id, max(o) FILTER (op = 'delete') AS de, max(o) FILTER (op = 'create') AS cr FROM ch GROUP BY id),
    li AS (SELECT ch.* FROM ch JOIN g USING (id) WHERE (de IS NULL OR o > de) AND op <> 'delete'),
    nw AS (SELECT id, arg_max(name, o) FILTER (name IS NOT NULL) AS name, arg_max(color, o) FILTER (color IS NOT NULL) AS color FROM li GROUP BY id),
    kp AS (SELECT c.id, CASE WHEN de IS NULL THEN c.name END AS name, CASE WHEN de IS NULL THEN c.color END AS color FROM collections c LEFT JOIN g USING (id) WHERE de IS NULL OR cr > de),
    md AS (SELECT id FROM g WHERE cr IS NOT NULL AND (de IS NULL OR cr > de))
    SELECT id, coalesce(nw.name, kp.name) AS name, coalesce(nw.color, kp.color) AS color FROM kp FULL JOIN md USING (id) LEFT JOIN nw USING (id)""")
def collections_after_changes(spark, d):
    """Collections after a log of creations, renamings and deletions."""
    m = _docs(spark, d).where("collection_id is not null")
    op = F.when(F.col("doc_id") % 97 == 0, "delete").when(F.col("doc_id") % 97 == 1, "create").otherwise("update")
    log = m.select(F.col("collection_id").alias("id"), op.alias("op"), F.col("source").alias("name"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("color"), F.coalesce("created_at", "ingested_at").alias("at"), F.col("doc_id").alias("seq"))
    return state.apply_changes(table(spark, d, "collections").select("id", "name", "color"), log, "id", ["name", "color"])


@query("""WITH ev AS (SELECT conversation_id AS id, CASE WHEN lower(trim(role)) = 'system' THEN 'create' WHEN content IS NULL OR content = '' THEN 'delete' ELSE 'message' END AS op, CASE WHEN lower(trim(role)) = 'system' THEN substr(content, 1, 60) END AS title, received_at AS tm, id AS seq FROM messages WHERE conversation_id IS NOT NULL),
    dl AS (SELECT id, max((tm, seq)) AS d FROM ev WHERE op = 'delete' GROUP BY id), li AS (SELECT ev.* FROM ev LEFT JOIN dl USING (id) WHERE d IS NULL OR (tm, seq) > d)
    SELECT id, arg_max(title, (tm, seq)) FILTER (title IS NOT NULL) AS title, sum(CASE WHEN op = 'message' THEN 1 ELSE 0 END)::BIGINT AS messages, epoch_us(max(tm)) AS updated_us FROM li GROUP BY id HAVING count(*) FILTER (op = 'create') > 0""")
def conversations_after_log(spark, d):
    m = table(spark, d, "messages").where("conversation_id is not null")
    system = F.lower(F.trim("role")) == "system"
    op = F.when(system, "create").when(F.col("content").isNull() | (F.col("content") == ""), "delete").otherwise("message")
    log = m.select(F.col("conversation_id").alias("id"), op.alias("op"), F.when(system, F.substring("content", 1, 60)).alias("title"), F.col("received_at").alias("at"), F.col("id").alias("seq"))
    return state.conversation_log(log).select("id", "title", "messages", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query("""WITH q AS (SELECT CASE WHEN vec_id % 40 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN vec_id % 4 = 0 THEN 'pending' ELSE 'completed' END AS status FROM vectors WHERE doc_id IS NOT NULL)
    SELECT 'row' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q WHERE status = 'pending')
    UNION ALL SELECT CASE WHEN status <> 'pending' THEN status WHEN doc_id IN (SELECT doc_id FROM documents) THEN 'completed' ELSE 'failed' END, doc_id FROM q""")
def deletions_compacted(spark, d):
    """Rows that the pending deletions leave, and the queue after them."""
    v = table(spark, d, "vectors").where("doc_id is not null")
    q = v.select(F.when(F.col("vec_id") % 40 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("vec_id") % 4 == 0, "pending").otherwise("completed").alias("status"))
    left, queue = state.compacted(_docs(spark, d).select("doc_id"), q)
    return left.select(F.lit("row").alias("kind"), "doc_id").unionByName(queue.select(F.col("status").alias("kind"), "doc_id"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def pending_deep_phase(spark, d):
    """Texts that the first phase of ingestion knows and the second has not done."""
    f = _docs(spark, d).where("text is not null").select("doc_id", "lang", F.sha2("text", 256).alias("file_hash"))
    return state.pending_deep(f.drop("lang"), f.where("lang = 'en'").select("file_hash"))


@query("""WITH c AS (SELECT 'has_text' AS name, count(*) AS n, sum(CASE WHEN coalesce(text <> '', false) THEN 0 ELSE 1 END)::BIGINT AS bad FROM documents UNION ALL SELECT 'has_source', count(*), sum(CASE WHEN source IS NULL THEN 1 ELSE 0 END)::BIGINT FROM documents
        UNION ALL SELECT 'chars_true', count(*), sum(CASE WHEN coalesce(n_chars = length(text), false) THEN 0 ELSE 1 END)::BIGINT FROM documents UNION ALL SELECT 'repeated_keys', count(*), (count(*) - count(DISTINCT doc_id))::BIGINT FROM documents)
    SELECT name AS "check", n, bad, CASE WHEN bad = 0 THEN 'ok' WHEN bad < 0.01 * n THEN 'warning' ELSE 'critical' END AS status FROM c""")
def table_health(spark, d):
    checks = {"has_text": F.col("text") != "", "has_source": F.col("source").isNotNull(), "chars_true": F.col("n_chars") == F.char_length("text")}
    return state.health(_docs(spark, d), "doc_id", checks)


# -- saved tables ----------------------------------------------------------------------------------


@query(f"""WITH {oracle.bm25()}, {oracle.run()}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents WHERE text IS NOT NULL)
    SELECT qid, canonical AS doc_id, min(rnk) AS rnk FROM sp JOIN c USING (doc_id) GROUP BY qid, canonical""")
def results_by_saved_map(spark, d):
    """Results promoted to what stands for them, by a deduplication map written and read again."""
    at = _folder(spark)
    state.save_map(dedup.exact_groups(_docs(spark, d)).select("doc_id", "canonical"), at)
    return state.promoted(_sparse_run(spark, d).select("qid", "doc_id", "rnk"), spark, at)


@query("SELECT id AS doc_id, md5(text) AS text_md5, source FROM documents")
def jsonl_round_trip(spark, d):
    at = _folder(spark)
    writers.write_jsonl(_docs(spark, d).select("id", "text", "source"), at)
    return readers.chunks_jsonl(spark, at).select("doc_id", F.md5("text").alias("text_md5"), F.get_json_object("metadata", "$.source").alias("source"))


@query("SELECT id, doc_id FROM documents")
def append_round_trip(spark, d):
    """A table that grows by what it does not hold yet."""
    at = _folder(spark)
    rows = _docs(spark, d).select("id", "doc_id")
    writers.append_new(rows.where("doc_id % 3 = 0"), at, "id")
    writers.append_new(rows, at, "id")
    return readers.chunks_parquet(spark, at)


@query(f"WITH {oracle.bm25()} SELECT term, df.df, sum(tf)::BIGINT AS uses FROM df JOIN tf USING (term) GROUP BY term, df.df")
def index_round_trip(spark, d):
    """The sparse index written as tables and read again."""
    at = _folder(spark)
    writers.save_index(_docs(spark, d), at)
    i = writers.load_index(spark, at)
    return i["tf"].groupBy("term").agg(F.sum("tf").alias("uses")).join(i["df"], "term").select("term", "df", "uses")


# -- vector index ----------------------------------------------------------------------------------


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def pq_search_recall(spark, d):
    """Whether the search by product codes finds nine in ten of the exact ten best of each stated query."""
    v, q = _vectors(spark, d), _vector_queries(spark, d)
    model = vector_index.fit(v)
    found = vector_index.search(vector_index.coded(v, model), model, q, 10).select("qid", "doc_id")
    from papyrine.operators.dense import cosine_top_k

    exact = cosine_top_k(v, q, 10).select("qid", "doc_id")
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return hits.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query("SELECT vec_id AS doc_id, label FROM embeddings WHERE embedding IS NOT NULL")
def index_after_append(spark, d):
    """What an index holds that was built of half the rows, grown by all and trained again."""
    root, v = _folder(spark), _vectors(spark, d)
    half = v.where("doc_id % 2 = 0")
    model = vector_index.fit(half)
    vector_index.save(vector_index.coded(half, model), model, root)
    vector_index.append(v, root)
    vector_index.rebuild(spark, root)
    return vector_index.load(spark, root)[0].select("doc_id", "label")


@query(f"WITH {oracle.bm25()}, {oracle.run()} SELECT qid, doc_id, rnk, score, sim FROM sp")
def search_without_index(spark, d):
    """The searcher's way where no index is kept: texts are scored as they stand."""
    s = sparse_ops.bm25_scores(_docs(spark, d), _items(spark, d))
    return sparse_ops._ranked(s, 10, "doc_id")


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
