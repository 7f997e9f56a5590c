"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import conversations, encodings, languages, leakage, near_duplicates, neighbours, packing, pairs, splitting
from papyrine.plans.layout import table


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches of one language, with confidence."""
    model = languages.fit(table(spark, d, "lang_samples"))
    return languages.language_segments(table(spark, d, "documents"), model).select("doc_id", "seg_no", "lang", "confidence", "first_char", "end_char")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    model = languages.fit(table(spark, d, "lang_samples"))
    return languages.wrong_labels(languages.language_segments(table(spark, d, "documents"), model)).select("doc_id", "seg_no", "lang")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    model = languages.fit(table(spark, d, "lang_samples"))
    return pairs.defective_pairs(table(spark, d, "evaluations"), model)


def p2_defects_by_model(spark: SparkSession, d: str) -> DataFrame:
    """How many of each model's answers are defective, by defect."""
    e = table(spark, d, "evaluations")
    return p2_found(spark, d).join(e.select("id", "model_used"), "id").groupBy("model_used", "defect").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(splitting.split_pieces(table(spark, d, "documents")))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return splitting.split_pieces(table(spark, d, "documents"))


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every split text put together again from its pieces without their overlaps."""
    p = splitting.split_pieces(table(spark, d, "documents")).select("doc_id", "piece_no", F.expr("substring(piece, overlap + 1)").alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda x: x["part"]), "")
    return p.groupBy("doc_id").agg(F.md5(whole).alias("text_md5"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates.similar_pairs(table(spark, d, "documents"), 0.5)
    return near_duplicates.all_pairs(members, links).select("doc_id_a", "doc_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every document at similarity 0.8, and its number of links to other texts."""
    members, links = near_duplicates.similar_pairs(table(spark, d, "documents"), 0.8)
    return near_duplicates.duplicate_groups(members, links)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, d, "vectors"), dims=(64, 32)))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ranked neighbours of every vector."""
    return neighbours.nearest(table(spark, d, "vectors"), dims=(64, 32)).select("vec_id", "rank", "neighbour", F.round("similarity", 9).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of one conversation id are parts of one conversation."""
    kept = conversations.rebuild_conversations(table(spark, d, "messages"), table(spark, d, "conversations"), join_sessions=True)
    return kept.select("conversation_id", "turn_no", "message_id", "role")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Channels split into sessions at the calibrated inactivity gap, missing roles inferred."""
    kept = conversations.rebuild_conversations(table(spark, d, "messages"), infer_roles=True)
    return kept.groupBy("conversation_id", "session_no").agg(F.count("*").alias("turns"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one longer than a container, with its container."""
    return packing.pack(packing.token_lengths(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by tokens held."""
    held = p8_packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("held"), F.count("*").alias("items"))
    return held.groupBy("held").agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: documents packed, documents whose parts leave a gap, containers over their capacity, and whether they are within a hundredth (and one) of the fewest possible."""
    packed = packing.pack(packing.token_lengths(table(spark, d, "documents")))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    full = packed.groupBy("container").agg(F.sum("tokens").alias("held")).agg(F.sum((F.col("held") > packing.CAPACITY).cast("long")).alias("over_full"), F.count("*").alias("c"), F.sum("held").alias("all"))
    counted = docs.agg(F.count("*").alias("documents"), F.sum((F.col("t") != F.col("end")).cast("long")).alias("gaps"))
    return counted.crossJoin(full).select("documents", "gaps", "over_full", (F.col("c") <= F.ceil(F.col("all") / packing.CAPACITY) * 1.01 + 1).alias("close"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).where("kind = 'exact'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact and paraphrased leaks with their scores."""
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"), paraphrases=True)
    return found.select("doc_id", "item_id", "kind", F.round("lcs_share", 6).alias("lcs_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_documents(table(spark, d, "documents")).select("doc_id", "restored_md5")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored texts."""
    return encodings.garbled_documents(table(spark, d, "documents")).where("restored is not null").select("doc_id", "restored")


def queries() -> dict:
    found = [p1_found, p1_segments, p2_found, p2_defects_by_model, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_groups, p5_found, p5_neighbours, p6_found, p6_sessions, p8_packed, p8_fill, p8_balance, p9_found, p9_leaks, p10_found, p10_restored]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": r"""
            SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[^\s\x{85}\p{Z}]{1000}[^\s\x{85}\p{Z}]{1000}[^\s\x{85}\p{Z}]') THEN 1 ELSE 0 END AS INTEGER) AS forced
            FROM documents WHERE length(text) > 2000""",
        "p4_found": f"""
            WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
            SELECT doc_id_a, doc_id_b FROM c JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b
            WHERE c * 2 >= x.n + y.n - c""",
        "p3_rebuilt": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE length(text) > 2000",
        "p4_groups": f"""
            WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            h AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY doc_id),
            m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep, n FROM h),
            r AS (SELECT s.* FROM s JOIN m ON m.doc_id = s.doc_id AND m.rep = s.doc_id),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM c JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8),
            e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
            reach(x, y) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT q.x, e.y FROM reach q JOIN e ON q.y = e.x)
            SELECT m.doc_id, g.group_id, m.rep, coalesce(k.links, 0) AS links FROM m JOIN (SELECT x AS rep, min(y) AS group_id FROM reach GROUP BY x) g USING (rep) LEFT JOIN (SELECT x AS rep, count(*) AS links FROM e GROUP BY x) k USING (rep)""",
        "p5_neighbours": r"""
            WITH u AS (SELECT vec_id, dim, min(vector) AS v FROM vectors
                       WHERE dim IN (32, 64) AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                         AND len(list_filter(vector, lambda x: x <> 0)) > 0
                       GROUP BY vec_id, dim),
            d AS (SELECT vec_id, dim, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM u),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 12) AS s,
                         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS r
                  FROM d a JOIN d b ON a.dim = b.dim AND a.vec_id <> b.vec_id)
            SELECT a AS vec_id, CAST(r AS INTEGER) AS rank, b AS neighbour, round(s, 9) AS similarity FROM p WHERE r <= 10""",
        "p8_balance": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS over_full, true AS close FROM documents",
        "p5_found": r"""
            WITH u AS (SELECT vec_id, dim, min(vector) AS v FROM vectors
                       WHERE dim IN (32, 64) AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                         AND len(list_filter(vector, lambda x: x <> 0)) > 0
                       GROUP BY vec_id, dim),
            d AS (SELECT vec_id, dim, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM u),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b,
                         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS r
                  FROM d a JOIN d b ON a.dim = b.dim AND a.vec_id <> b.vec_id)
            SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM p WHERE r <= 10""",
        "p6_found": r"""
            WITH RECURSIVE o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS n FROM messages WHERE id IS NOT NULL AND conversation_id IS NOT NULL) WHERE n = 1),
            p AS (SELECT id, conversation_id AS c, lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS r, regexp_replace(content, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g') AS s,
                         trim(created_at) AS t, json_extract_string(metadata, '$.reply_to') AS reply FROM o),
            q AS (SELECT id, c, s, reply, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN r = 'system' THEN 'system' END AS role,
                         CASE WHEN regexp_matches(t, '^\d{10}$') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN TRY_CAST(t AS BIGINT) * 1000
                              ELSE epoch_us(TRY_CAST(replace(regexp_extract(t, '^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?)', 1), 'T', ' ') AS TIMESTAMP))
                                   - coalesce(TRY_CAST(regexp_extract(t, '([+-])(\d\d):(\d\d)$', 1) || '1' AS BIGINT) * (TRY_CAST(regexp_extract(t, '[+-](\d\d):(\d\d)$', 1) AS BIGINT) * 60 + TRY_CAST(regexp_extract(t, '[+-](\d\d):(\d\d)$', 2) AS BIGINT)) * 60000000, 0) END AS tm FROM p),
            k AS (SELECT c FROM q GROUP BY c HAVING bool_and(coalesce(role IS NOT NULL AND tm IS NOT NULL AND length(regexp_replace(s, '[\s\p{Z}\p{C}]', '', 'g')) > 0, false))),
            g AS (SELECT q.* FROM q WHERE c IN (SELECT c FROM k) AND c IN (SELECT id FROM conversations)),
            dp(id, depth) AS (SELECT a.id, 0 FROM g a LEFT JOIN g b ON b.c = a.c AND b.tm = a.tm AND b.id = a.reply WHERE b.id IS NULL
                              UNION ALL SELECT a.id, d.depth + 1 FROM dp d JOIN g b ON b.id = d.id JOIN g a ON a.c = b.c AND a.tm = b.tm AND a.reply = b.id),
            l AS (SELECT g.*, depth, lag(role) OVER w AS lr, lag(s) OVER w AS ls FROM g JOIN dp USING (id) WINDOW w AS (PARTITION BY c ORDER BY tm, depth, id)),
            u AS (SELECT *, CASE role WHEN 'system' THEN lr IS NULL OR lr = 'system' WHEN 'user' THEN lr IS NULL OR lr IN ('system', 'assistant') ELSE lr = 'user' END AS good FROM l WHERE lr IS NULL OR NOT (lr = role AND ls = s)),
            f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tm, depth, id) AS n, last_value(role) OVER (PARTITION BY c ORDER BY tm, depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastr,
                         min(CASE WHEN coalesce(good, false) THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS ok FROM u)
            SELECT c AS conversation_id, CAST(n - 1 AS INTEGER) AS turn_no, id AS message_id, role FROM f WHERE ok = 1 AND lastr = 'assistant'""",
        "p9_found": f"""
            WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            ds AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
            bs AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM bw WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (g)""",
    }
