"""SQL of the core queries, written from the definitions and not from the plans."""

from __future__ import annotations

_TOK = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2)"
_ANY = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_SPACE = r"[\s\x0B\p{Z}]+"


def tok(c: str) -> str:
    return _TOK.format(c=c)


def words(c: str) -> str:
    return _ANY.format(c=c)


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"


def raw(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_SPACE}'), lambda x: x <> '')"


ABBR = r"(?i)(^|[^\p{L}\p{N}_])(U\.S\.A|U\.S|U\.K|e\.g|i\.e|Prof|Mrs|Mr|Dr|Ms|Sr|Jr|vs|v|etc|Art|No|Fig|Vol)\."


def sentences(c: str) -> str:
    marked = f"regexp_replace({clean(c)}, '{ABBR}', '\\1\\2' || chr(1), 'g')"
    parts = f"string_split(regexp_replace({marked}, '([.!?]) +', '\\1' || chr(2), 'g'), chr(2))"
    return f"list_filter(list_transform({parts}, lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


def bm25(k1: float = 1.5, avgdl: str = "avg(dl)") -> str:
    return f"""
    tok AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
    dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
    st AS (SELECT count(*) AS n, {avgdl} AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT qid, term, count(*) AS qf FROM (SELECT item_id AS qid, unnest({tok('text')}) AS term FROM benchmark) GROUP BY qid, term),
    sc AS (SELECT q.qid, t.doc_id, sum(q.qf * ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE) + 1.0::DOUBLE)
             * (t.tf * {k1 + 1.0}::DOUBLE) / (t.tf + {k1}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.avgdl))) AS score
           FROM qt q JOIN tf t ON q.term = t.term JOIN df ON df.term = t.term JOIN dl ON dl.doc_id = t.doc_id CROSS JOIN st GROUP BY q.qid, t.doc_id)"""


def run(k: int = 10, where: str = "", name: str = "sp") -> str:
    return f"""{name} AS (SELECT qid, doc_id, rnk, round(score, 6) AS score, round(least(score / 15.0::DOUBLE, 1.0::DOUBLE), 6) AS sim FROM
        (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rnk FROM sc {where}) WHERE rnk <= {k})"""


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def dense(queries: str, rows: str = "embeddings", k: int = 10, name: str = "dn") -> str:
    return f"""{name} AS (SELECT qid, doc_id, rnk, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rnk
        FROM (SELECT q.qid, v.vec_id AS doc_id, {_COS.format(a='q.qvec', b='v.embedding')} AS score FROM ({queries}) q CROSS JOIN {rows} v)) WHERE rnk <= {k})"""


ITEMQ = "SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id"
STATED = "SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0"
BOTH = """bo AS (SELECT qid, doc_id, coalesce(s.score, 0.0) AS bm25, coalesce(d.score, 0.0) AS cosine FROM sp s FULL JOIN dn d USING (qid, doc_id))"""
FUSED = f"WITH {bm25()}, {run()}, {dense(ITEMQ)}"

_QRELS = f"""bw AS (SELECT item_id AS qid, {words('text')} AS w FROM benchmark),
    bg AS (SELECT DISTINCT qid, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT qid, w, unnest(range(1, len(w) - 6)) AS i FROM bw WHERE len(w) >= 8)),
    dw AS (SELECT doc_id, {words('text')} AS w FROM documents),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
    qrels AS (SELECT DISTINCT qid, doc_id FROM bg JOIN dg USING (g))"""


def metrics(runs: str, ks: str, by: str = "") -> str:
    """CTE ``pq`` over a run table; all judgements are 1, so both gains agree."""
    b = f"{by}, " if by else ""
    return f"""ks AS (SELECT unnest([{ks}]) AS k), nrel AS (SELECT qid, count(*) AS n_relevant FROM qrels GROUP BY qid),
    modes AS (SELECT DISTINCT {by or "1 AS one"} FROM {runs}),
    ht AS (SELECT {b}r.qid, r.rnk FROM {runs} r JOIN qrels USING (qid, doc_id)),
    pq AS (SELECT {b.replace(by, 'm.' + by) if by else ''}n.qid, k, n.n_relevant, count(h.rnk) AS hits, count(h.rnk) / n.n_relevant::DOUBLE AS recall, count(h.rnk) / least(k, n.n_relevant)::DOUBLE AS recall_capped,
             count(h.rnk) / k::DOUBLE AS precision, coalesce(sum(1.0 / log2(h.rnk + 1.0)), 0.0) / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, CAST(least(k, n.n_relevant) AS BIGINT) + 1) t(i)) AS ndcg,
             coalesce(1.0 / min(h.rnk), 0.0) AS mrr
           FROM nrel n CROSS JOIN ks CROSS JOIN modes m LEFT JOIN ht h ON h.qid = n.qid AND h.rnk <= k {f'AND h.{by} = m.{by}' if by else ''} GROUP BY {('m.' + by + ', ') if by else ''}n.qid, k, n.n_relevant)"""


_AVGS = "round(avg(recall), 6) AS recall, round(avg(recall_capped), 6) AS recall_capped, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(ndcg), 6) AS ndcg_exp, round(avg(mrr), 6) AS mrr"

def _route(t: str, c: str, f: str, n: str, e: str, z: str) -> str:
    return rf"""CASE WHEN regexp_matches(trim(q), '(?i)\b(when|date|year|in \d{{4}}|\d{{4}}-\d{{4}}|last|ago|recent|when did)\b') THEN {t}
    WHEN regexp_matches(trim(q), '(?i)\b(compare|vs\b|versus|which is better|is .* better)\b') THEN {c}
    WHEN regexp_matches(trim(q), '(?i)^(what is|who is|define|where is|how many|how much)\b') THEN {f}
    WHEN regexp_matches(trim(q), '(?i)\b(what does .* mean|why|how (does|do))\b') THEN {n}
    WHEN regexp_matches(trim(q), '(?i)\b(explain|tell me about|overview|summary|describe)\b') THEN {e} ELSE {z} END"""


def _at_start(p: str) -> str:
    return f"(CASE WHEN regexp_matches(trim(q), '(?i)^(?:{p})') THEN 0.9 ELSE 0.7 END)"


_ALT = r"""CASE WHEN regexp_matches(lower(question), '\b(what is|who is|when did|how many|define|list)\b') THEN 'factual'
    WHEN regexp_matches(lower(question), '\b(recent|latest|last|20\d{2}|this year)\b') THEN 'temporal'
    WHEN regexp_matches(lower(question), '\b(compare|versus|vs|difference between|better than)\b') THEN 'comparative'
    WHEN regexp_matches(lower(question), '\b(explain|why|how does|relationship|impact)\b') THEN 'conceptual' ELSE 'exploratory' END"""

_SHINGLE = f"""rw AS (SELECT doc_id, {raw('text')} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM rw WHERE len(w) >= 5)),
    hs AS (SELECT doc_id, md5(string_agg(s, '' ORDER BY s)) AS h FROM sh GROUP BY doc_id),
    reps AS (SELECT h, min(doc_id) AS doc_id FROM hs GROUP BY h)"""


def minhash() -> str:
    from papyrine.operators.dedup import FINE_BANDS, FINE_ROWS, PERMUTATIONS, PRIME, permutation

    perms = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(map(permutation, range(PERMUTATIONS))))
    return f"""{_SHINGLE},
    pm AS (SELECT * FROM (VALUES {perms}) t(i, a, b)),
    xs AS (SELECT doc_id, CAST('0x' || substr(s, 1, 7) AS BIGINT) AS x FROM sh JOIN reps USING (doc_id)),
    mh AS (SELECT doc_id, i, min((x * a + b) % {PRIME}) AS m FROM xs CROSS JOIN pm GROUP BY doc_id, i),
    sg AS (SELECT doc_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS s FROM mh GROUP BY doc_id),
    bd AS (SELECT doc_id, i // {FINE_ROWS} AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS h FROM mh WHERE i < {FINE_BANDS * FINE_ROWS} GROUP BY doc_id, i // {FINE_ROWS}),
    cp AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bd x JOIN bd y USING (band, h) WHERE x.doc_id < y.doc_id)"""


_SIMILAR = f"""{_SHINGLE}, rs AS (SELECT doc_id, s FROM sh JOIN reps USING (doc_id)), rn AS (SELECT doc_id, count(*) AS n FROM rs GROUP BY doc_id),
    bo AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rs x JOIN rs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    cp AS (SELECT a, b, c / (p.n + q.n - c)::DOUBLE AS similarity FROM bo JOIN rn p ON p.doc_id = a JOIN rn q ON q.doc_id = b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8)"""


_LINKS = """lk AS (SELECT a, b FROM cp UNION SELECT r.doc_id AS a, hs.doc_id AS b FROM hs JOIN reps r USING (h) WHERE r.doc_id <> hs.doc_id),
    ed AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN ed e ON r.y = e.x),
    comp AS (SELECT x AS doc_id, min(y) AS cluster_id FROM reach GROUP BY x)"""


def _guessed() -> str:
    from papyrine.functions.text import FUNCTION_WORDS

    order = ["en", *sorted(k for k in FUNCTION_WORDS if k != "en")]
    rows = ", ".join(f"({i}, '{k}', [{', '.join(repr(w) for w in FUNCTION_WORDS[k])}])" for i, k in enumerate(order))
    return rf"""WITH l AS (SELECT * FROM (VALUES {rows}) v(i, k, ws)), t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
        c AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter(w, lambda x: list_contains(ws, x))) DESC, i) AS r FROM t CROSS JOIN l)
        SELECT doc_id, k AS language FROM c WHERE r = 1"""


def _stems() -> str:
    from papyrine.functions.stemming import ENDINGS, LEAST_STEM

    cases = " ".join(f"WHEN '{k}' THEN regexp_replace(x, '^(.{{{LEAST_STEM},}}?)(?:{'|'.join(e)})$', '\\1')" for k, e in ENDINGS.items())
    return f"""SELECT doc_id, CAST(count(DISTINCT CASE language {cases} ELSE x END) AS INTEGER) AS stems FROM ({_guessed()}) g JOIN (SELECT doc_id, unnest(CASE WHEN len({tok('text')}) = 0 THEN [NULL] ELSE {tok('text')} END) AS x FROM documents WHERE text IS NOT NULL) USING (doc_id) GROUP BY doc_id
        UNION ALL SELECT doc_id, -1 FROM documents WHERE text IS NULL"""


def _compounds() -> str:
    from papyrine.functions.stemming import COMPOUND_TAILS, LINKS, MIDDLES

    tails, three, two, link = "|".join(COMPOUND_TAILS), "^(.{4,}?)grund(?:{t})$", "^(.{4,}?)({t})$", f"^(.{{4,}})(?:{'|'.join(LINKS)})(.{{4,}})$"
    three, two = three.replace("{t}", tails), two.replace("{t}", tails)
    size = "least(12, length(x) - 6)"
    spot = f"list_filter(range(3, length(x) - {size} - 2), lambda i: regexp_matches(substr(x, CAST(i AS BIGINT) + 1, {size}), '{'|'.join(MIDDLES)}'))[1]"
    return f"""WITH w AS (SELECT doc_id, {tok('text')} AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_guessed()}) WHERE language = 'de')),
        e AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        p AS (SELECT doc_id, i, CASE WHEN length(x) < 10 THEN x
            WHEN regexp_matches(x, '{three}') THEN x || ' ' || regexp_extract(x, '{three}', 1) || ' grund ' || substr(x, length(regexp_extract(x, '{three}', 1)) + 6)
            WHEN regexp_matches(x, '{two}') THEN x || ' ' || regexp_extract(x, '{two}', 1) || ' ' || regexp_extract(x, '{two}', 2)
            WHEN regexp_matches(x, '{link}') THEN x || ' ' || regexp_extract(x, '{link}', 1) || ' ' || regexp_extract(x, '{link}', 2)
            WHEN {spot} IS NOT NULL THEN x || ' ' || substr(x, 1, {spot}) || ' ' || substr(x, {spot} + 1, {size}) || ' ' || substr(x, {spot} + {size} + 1)
            ELSE x END AS ps FROM e)
        SELECT w.doc_id, CAST(len(any_value(ws)) AS INTEGER) AS words, md5(coalesce(string_agg(ps, ' ' ORDER BY i), '')) AS parts_md5 FROM w LEFT JOIN p USING (doc_id) GROUP BY w.doc_id"""


def _audit() -> str:
    from papyrine.functions.text import QUERY_PHRASES

    cases = " ".join(f"WHEN regexp_matches(message, '{p.replace(chr(39), chr(39) * 2)}') THEN replace(message, regexp_extract(message, '{p.replace(chr(39), chr(39) * 2)}', 1), sha256(regexp_extract(message, '{p.replace(chr(39), chr(39) * 2)}', 1)))" for p in QUERY_PHRASES)
    return f"SELECT log_id, upper(level) AS level, component, CASE {cases} ELSE message END AS message FROM logs_fts WHERE component <> 'log' AND timestamp >= '2025-01-10' AND timestamp < '2025-01-12'"


def _log_entries() -> str:
    """Entries by one expression for each layout; times are parts put together, not casts of whole lines."""
    lv = "(?:debug|dbg|info|inf|warning|warn|error|err|critical|crit|fatal)"
    iso = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?(?:Z|[+-]\d\d:?\d\d))?"
    comp = r"[\w$][\w$./-]*"
    # name, expression, and the numbers of the groups that hold time, level and component
    layouts = [
        ("a", rf"^({iso}) - ({lv}) - ({comp}) - .*$", 1, 2, 3),
        ("b", rf"^({iso}) \| ({lv}) +\| ({comp}) +\| .*$".replace(" +", " *"), 1, 2, 3),
        ("c", rf"^\[({iso})\] \[({lv})\] \[({comp})\] ?.*$", 1, 2, 3),
        ("d", rf"^([A-Z][a-z][a-z] [ \d]\d \d\d:\d\d:\d\d) \S+ ({comp})(?:\[\d+\])?: <({lv})> ?.*$", 1, 3, 2),
        ("e", rf'^"(\d\d/[A-Z][a-z][a-z]/\d{{4}}:\d\d:\d\d:\d\d [+-]\d{{4}})","({lv})","({comp})",".*"$', 1, 2, 3),
        ("f", rf"^(\d\d:\d\d:\d\d\.\d+) \[[^\]]*\] ({lv}) +({comp}) - .*$", 1, 2, 3),
        ("g", rf"^({lv}) +\[({comp})\] (\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d) .*$", 3, 1, 2),
        ("h", rf"^([DIWEFC])(\d{{4}} \d\d:\d\d:\d\d\.\d+) +\d+ ({comp}):\d+\] .*$", 2, 1, 3),
        ("i", rf"^(\d{{10}}\.\d+|\d{{13}}) ({lv}) ({comp}): .*$", 1, 2, 3),
        ("j", r'^(?:[\w.-]+ +\| )?\{"asctime": "([^"]*)", "levelname": "([^"]*)", "name": "([^"]*)", .*\}$', 1, 2, 3),
    ]
    flag = lambda n: "" if n in "dh" else "(?i)"
    quote = lambda p: p.replace("'", "''")
    get = lambda k: " ".join(f"WHEN regexp_matches(message, '{flag(n)}{quote(p)}') THEN regexp_extract(message, '{flag(n)}{quote(p)}', {(t, v, c)[k]})" for n, p, t, v, c in layouts)
    pair = lambda k: f"regexp_extract(message, '(?:^| ){k}=(\\S+)', 1)"
    is_pairs = "regexp_matches(message, '(?:^| )level=') AND regexp_matches(message, '(?:^| )ts=') AND regexp_matches(message, '(?:^| )component=')"
    field = lambda k: f"regexp_extract(message, '^\\s+\"{k}\"\\s*:\\s*\"([^\"]*)\"', 1)"
    name_date = "regexp_extract(logfile, '(\\d{4}(?:-\\d\\d-\\d\\d)?)\\.log$', 1)"
    month = "lpad(CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', {m}) + 2) // 3 AS VARCHAR), 2, '0')"
    plain = f"""CASE
        WHEN regexp_matches(tm, '^\\d{{4}}[-/]') THEN replace(replace(replace(substr(tm, 1, 19), 'T', ' '), '/', '-'), ',', '.')
        WHEN regexp_matches(tm, '^\\d\\d/[A-Z]') THEN substr(tm, 8, 4) || '-' || {month.format(m='substr(tm, 4, 3)')} || '-' || substr(tm, 1, 2) || ' ' || substr(tm, 13, 8)
        WHEN regexp_matches(tm, '^[A-Z]') THEN substr({name_date}, 1, 4) || '-' || {month.format(m='substr(tm, 1, 3)')} || '-' || replace(substr(tm, 5, 2), ' ', '0') || ' ' || substr(tm, 8, 8)
        WHEN regexp_matches(tm, '^\\d{{4}} ') THEN substr({name_date}, 1, 4) || '-' || substr(tm, 1, 2) || '-' || substr(tm, 3, 2) || ' ' || substr(tm, 6, 8)
        WHEN regexp_matches(tm, '^\\d\\d:') THEN {name_date} || ' ' || substr(tm, 1, 8) END"""
    milli = "coalesce(TRY_CAST(rpad(substr(regexp_extract(tm, '\\d\\d:\\d\\d:\\d\\d[.,](\\d+)', 1), 1, 3), 3, '0') AS BIGINT), 0)"
    z = "regexp_extract(tm, '([+-])\\d\\d:?\\d\\d$', 1)"
    shift = f"CASE WHEN {z} <> '' AND regexp_matches(tm, ':\\d\\d(?:[.,]\\d+)? ?[+-]') THEN TRY_CAST({z} || '1' AS BIGINT) * (TRY_CAST(regexp_extract(tm, '[+-](\\d\\d):?(\\d\\d)$', 1) AS BIGINT) * 60 + TRY_CAST(regexp_extract(tm, '[+-](\\d\\d):?(\\d\\d)$', 2) AS BIGINT)) * 60000 ELSE 0 END"
    return f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logfile, line_no ORDER BY indexed_at, log_id) AS n FROM logs_fts) WHERE n = 1),
        l AS (SELECT logfile, line_no, message, component AS c0, level AS l0, "timestamp" AS t0, lead(message) OVER w AS m1, lead(message, 2) OVER w AS m2, lead(message, 3) OVER w AS m3 FROM o WINDOW w AS (PARTITION BY logfile ORDER BY line_no)),
        h AS (SELECT logfile, line_no,
                CASE WHEN c0 <> 'log' THEN t0 {get(0)} WHEN {is_pairs} THEN {pair('ts')} WHEN trim(message) = '{{' AND {field('timestamp').replace('message', 'm1')} <> '' THEN {field('timestamp').replace('message', 'm1')} END AS tm,
                CASE WHEN c0 <> 'log' THEN l0 {get(1)} WHEN {is_pairs} THEN {pair('level')} WHEN trim(message) = '{{' AND {field('timestamp').replace('message', 'm1')} <> '' THEN {field('level').replace('message', 'm2')} END AS lv,
                CASE WHEN c0 <> 'log' THEN c0 {get(2)} WHEN {is_pairs} THEN {pair('component')} WHEN trim(message) = '{{' AND {field('timestamp').replace('message', 'm1')} <> '' THEN {field('component').replace('message', 'm3')} END AS co FROM l),
        s AS (SELECT *, max(CASE WHEN tm IS NOT NULL THEN line_no END) OVER (PARTITION BY logfile ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM h),
        e AS (SELECT logfile, f, max(line_no) AS last_line FROM s WHERE f IS NOT NULL GROUP BY logfile, f)
        SELECT e.logfile, f AS first_line, e.last_line,
            CASE WHEN lower(lv) IN ('debug', 'dbg', 'd') THEN 'DEBUG' WHEN lower(lv) IN ('info', 'inf', 'i') THEN 'INFO' WHEN lower(lv) IN ('warning', 'warn', 'w') THEN 'WARNING' WHEN lower(lv) IN ('error', 'err', 'e') THEN 'ERROR' ELSE 'CRITICAL' END AS level, co AS component,
            CASE WHEN regexp_matches(tm, '^\\d{{13}}$') THEN CAST(tm AS BIGINT) WHEN regexp_matches(tm, '^\\d{{10}}\\.') THEN CAST(substr(tm, 1, 10) || substr(rpad(substr(tm, 12), 3, '0'), 1, 3) AS BIGINT)
                 ELSE epoch_us(TRY_CAST({plain.replace('logfile', 'e.logfile')} AS TIMESTAMP)) // 1000 + {milli} - ({shift}) END AS event_ms
        FROM e JOIN h ON h.logfile = e.logfile AND h.line_no = e.f"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["bm25_topk"] = f"WITH {bm25()}, {run()} SELECT * FROM sp"
    sql["bm25_joined"] = f"WITH {bm25()} SELECT qid, count(*) AS n, round(sum(score), 3) AS total, round(max(score), 6) AS best FROM sc GROUP BY qid"
    sql["bm25_filtered_lang"] = f"WITH {bm25()}, {run(where=chr(10) + 'WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT * FROM sp"
    sql["bm25_fts_variant"] = f"WITH {bm25(1.2)}, {run()} SELECT qid, doc_id, rnk, score FROM sp"
    sql["bm25_fixed_length"] = f"WITH {bm25(1.5, '1000.0::DOUBLE')}, {run()} SELECT qid, doc_id, rnk, score FROM sp"
    sql["bm25_index_stats"] = f"WITH {bm25()} SELECT n, round(avgdl, 9) AS avgdl, (SELECT count(*) FROM tf) AS postings, CAST((SELECT sum(tf) FROM tf) AS BIGINT) AS tokens, (SELECT count(*) FROM df) AS terms FROM st"
    sql["bm25_document_frequency"] = f"WITH {bm25()} SELECT term, df FROM df"
    sql["bm25_adhoc_score"] = f"""WITH {bm25()},
        eq AS (SELECT id, term, count(*) AS qf FROM (SELECT id, unnest({tok('question')}) AS term FROM evaluations) GROUP BY id, term),
        ea AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len({tok('answer')}) AS dl, unnest({tok('answer')}) AS term FROM evaluations) GROUP BY id, term, dl)
        SELECT id, round(sum(qf * ln((n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM eq JOIN ea USING (id, term) LEFT JOIN df USING (term) CROSS JOIN st GROUP BY id"""
    sql["sparse_dot_topk"] = f"""WITH {bm25()}, s2 AS (SELECT q.qid, t.doc_id, sum(ln(1.0::DOUBLE + q.qf) * ln(1.0::DOUBLE + t.tf)) AS score FROM qt q JOIN tf t ON q.term = t.term GROUP BY 1, 2)
        SELECT qid, doc_id, rnk, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rnk FROM s2) WHERE rnk <= 10"""
    sql["sparse_dot_totals"] = f"""WITH {bm25()}, s2 AS (SELECT q.qid, t.doc_id, sum(ln(1.0::DOUBLE + q.qf) * ln(1.0::DOUBLE + t.tf)) AS score FROM qt q JOIN tf t ON q.term = t.term GROUP BY 1, 2) SELECT qid, count(*) AS n, round(sum(score), 3) AS total FROM s2 GROUP BY qid"""
    sql["dense_topk"] = f"WITH {dense(STATED)} SELECT qid, doc_id, rnk, score FROM dn"
    sql["dense_filtered"] = f"WITH {dense(STATED, '(SELECT * FROM embeddings WHERE label IN (1, 2, 3))')} SELECT qid, doc_id, rnk, score FROM dn"
    sql["ann_hot_cold_merge"] = f"""WITH {dense(STATED)}, t AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings)
        SELECT qid, doc_id, rnk, CASE WHEN i <= greatest(1, floor((SELECT count(*) FROM embeddings) * 0.2)) THEN 'hot' ELSE 'cold' END AS tier, score FROM dn JOIN t USING (doc_id)"""
    sql["vector_quantised"] = """WITH m AS (SELECT vec_id AS doc_id, embedding AS e, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 AS s FROM embeddings)
        SELECT doc_id, round(s, 9) AS step, CAST(list_sum(list_transform(e, lambda x: abs(round(CAST(x AS DOUBLE) / s)))) AS INTEGER) AS weight FROM m"""
    sql["access_promotions"] = "SELECT user_id AS doc_id, count(*) AS hits FROM events GROUP BY user_id HAVING count(*) >= 10 ORDER BY hits DESC, doc_id LIMIT 50"

    part = "coalesce({w}::DOUBLE / (60.0::DOUBLE + {r}), 0.0)"
    rrf = f"ff AS (SELECT qid, doc_id, {part.format(w=0.7, r='s.rnk')} + {part.format(w=0.3, r='d.rnk')} AS score, s.rnk AS sparse_rank, d.rnk AS dense_rank FROM sp s FULL JOIN dn d USING (qid, doc_id))"
    sql["rrf_fuse"] = f"{FUSED}, {rrf} SELECT qid, doc_id, round(score, 9) AS score, sparse_rank, dense_rank FROM ff"
    sql["combine_topk"] = f"{FUSED}, {rrf} SELECT qid, doc_id, rnk, round(score, 9) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rnk FROM ff) WHERE rnk <= 3"
    sql["rrf_weighted_sweep"] = f"""{FUSED}, g AS (SELECT CAST(k AS DOUBLE) AS k, CAST(ws AS DOUBLE) AS ws, CAST(wb AS DOUBLE) AS wb FROM (SELECT unnest([20, 60, 100]) AS k) CROSS JOIN (SELECT unnest([0.7, 1.0, 1.3]) AS ws) CROSS JOIN (SELECT unnest([0.7, 1.0, 1.3]) AS wb)),
        x AS (SELECT k, ws, wb, coalesce(wb / (k + s.rnk), 0.0) + coalesce(ws / (k + d.rnk), 0.0) AS score FROM sp s FULL JOIN dn d USING (qid, doc_id) CROSS JOIN g)
        SELECT k, ws, wb, count(*) AS n, round(sum(score), 6) AS total, round(max(score), 9) AS best FROM x GROUP BY k, ws, wb"""
    sql["hybrid_score_breakdown"] = f"""{FUSED}, {BOTH} SELECT qid, doc_id, round(cosine, 9) AS semantic, round(least(bm25 / 15.0::DOUBLE, 1.0), 9) AS keyword, round(cosine * 0.1::DOUBLE, 9) AS semantic_part,
        round(least(bm25 / 15.0::DOUBLE, 1.0) * 0.9::DOUBLE, 9) AS keyword_part, round(least(cosine * 0.1::DOUBLE + least(bm25 / 15.0::DOUBLE, 1.0) * 0.9::DOUBLE, 1.0), 9) AS total FROM bo"""
    sql["keyword_boost"] = f"""{FUSED}, {BOTH} SELECT qid, doc_id, round(CASE WHEN least(bm25 / 15.0::DOUBLE, 1.0) > 0.05 THEN least(cosine + least(bm25 / 15.0::DOUBLE, 1.0) * 0.3::DOUBLE, 1.0) ELSE cosine END, 6) AS boosted FROM bo"""
    sql["tier_boost"] = f"""{FUSED}, t AS (SELECT s.qid, s.doc_id, s.sim, (CASE WHEN s.rnk <= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + coalesce(d.score * 0.3::DOUBLE, 0.0::DOUBLE) AS boost FROM sp s LEFT JOIN dn d USING (qid, doc_id))
        SELECT qid, doc_id, round(boost, 6) AS boost, round(least(sim + boost, 1.0), 6) AS boosted FROM t"""
    base = f"WITH {bm25()}, {run()}"
    sql["norm_minmax"] = f"""{base} SELECT qid, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM sp)"""
    sql["norm_rank"] = f"""{base} SELECT qid, doc_id, round(CASE WHEN n > 1 THEN 1.0::DOUBLE - (rnk - 1.0::DOUBLE) / (n - 1.0::DOUBLE) ELSE 1.0 END, 6) AS norm FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM sp)"""
    sql["norm_zscore"] = f"""{base} SELECT qid, doc_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(CASE WHEN sd > 1e-12 THEN (score - mu) / sd ELSE 0.0 END))), 6) AS norm FROM (SELECT *, avg(score) OVER (PARTITION BY qid) AS mu, stddev_pop(score) OVER (PARTITION BY qid) AS sd FROM sp)"""
    sql["score_stats"] = f"{base} SELECT qid, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd FROM sp GROUP BY qid"

    label = _route(t="'temporal'", c="'comparative'", f="'factual'", n="'conceptual'", e="'exploratory'", z="'exploratory'")
    conf = _route(
        t=_at_start(r"\b(when|date|year|in \d{4}|\d{4}-\d{4}|last|ago|recent|when did)\b"),
        c=_at_start(r"\b(compare|vs\b|versus|which is better|is .* better)\b"),
        f=_at_start(r"(what is|who is|define|where is|how many|how much)\b"),
        n=_at_start(r"\b(what does .* mean|why|how (does|do))\b"),
        e=_at_start(r"\b(explain|tell me about|overview|summary|describe)\b"),
        z="0.5",
    )
    sql["route_classify"] = f"SELECT id, {label} AS label, CAST({conf} AS DOUBLE) AS confidence FROM (SELECT id, question AS q FROM evaluations WHERE question IS NOT NULL)"
    sql["route_alternative"] = f"SELECT id, {_ALT} AS label FROM evaluations"
    sql["route_strategy"] = f"""SELECT id, label, CAST(CASE label WHEN 'factual' THEN 0.6 WHEN 'conceptual' THEN 0.2 WHEN 'temporal' THEN 0.4 ELSE 0.3 END AS DOUBLE) AS sparse_weight,
        CAST(CASE label WHEN 'factual' THEN 0.4 WHEN 'conceptual' THEN 0.8 WHEN 'temporal' THEN 0.6 ELSE 0.7 END AS DOUBLE) AS dense_weight, label IN ('conceptual', 'comparative') AS use_reranker,
        CAST(CASE label WHEN 'factual' THEN 300 WHEN 'conceptual' THEN 400 WHEN 'comparative' THEN 250 WHEN 'temporal' THEN 375 ELSE 500 END AS INTEGER) AS candidates FROM (SELECT id, {_ALT} AS label FROM evaluations)"""
    two, one = r"(\d{4})\s*[-–]\s*(\d{4})", r"(?:^|[^\w])(\d{4})(?:[^\w]|$)"
    sql["temporal_filter"] = f"""SELECT id, CASE WHEN regexp_matches(question, '{two}') THEN regexp_extract(question, '{two}', 1) ELSE regexp_extract(question, '{one}', 1) END || '-01-01' AS start,
        CASE WHEN regexp_matches(question, '{two}') THEN regexp_extract(question, '{two}', 2) ELSE regexp_extract(question, '{one}', 1) END || '-12-31' AS "end" FROM evaluations
        WHERE regexp_matches(question, '{two}') OR regexp_matches(question, '{one}')"""
    sql["quant_alpha"] = """SELECT i, round(CASE WHEN i % 5 = 0 THEN a WHEN i % 7 = 0 THEN greatest(0.0, a - 0.15::DOUBLE) ELSE greatest(0.0, least(1.0, a - 1.75::DOUBLE * (i / 1000.0::DOUBLE))) END, 9) AS alpha,
        round(0.5::DOUBLE / (0.5::DOUBLE + 0.5::DOUBLE * greatest(0.0, 1.0::DOUBLE - a)), 9) AS sparse_weight, round(0.5::DOUBLE * greatest(0.0, 1.0::DOUBLE - a) / (0.5::DOUBLE + 0.5::DOUBLE * greatest(0.0, 1.0::DOUBLE - a)), 9) AS dense_weight
        FROM (SELECT i, i / 100.0::DOUBLE AS a FROM range(0, 101) t(i))"""
    ranked = "CAST(row_number() OVER (PARTITION BY qid ORDER BY round({s}, 6) DESC, doc_id) AS INTEGER) AS rnk"
    sql["rerank_blend"] = f"""{FUSED}, {BOTH}, b AS (SELECT qid, doc_id, cosine * 0.7::DOUBLE + least(bm25 / 15.0::DOUBLE, 1.0) * 0.3::DOUBLE AS s FROM bo)
        SELECT qid, doc_id, rnk, round(s, 6) AS rerank FROM (SELECT *, {ranked.format(s='s')} FROM b) WHERE rnk <= 5"""
    sql["rerank_gated"] = f"""{FUSED}, {BOTH}, b AS (SELECT qid, doc_id, CASE WHEN count(*) OVER (PARTITION BY qid) >= 12 THEN cosine ELSE least(bm25 / 15.0::DOUBLE, 1.0) END AS s FROM bo)
        SELECT qid, doc_id, rnk, round(s, 6) AS chosen FROM (SELECT *, {ranked.format(s='s')} FROM b) WHERE rnk <= 12"""
    sql["auto_merge"] = f"""{base}, c AS (SELECT qid, doc_id, sim, doc_id // 100 AS p FROM sp), m AS (SELECT *, max(sim) OVER (PARTITION BY qid, p) AS ps FROM c)
        SELECT qid, CASE WHEN ps > sim + 0.1::DOUBLE THEN p ELSE doc_id END AS doc_id, round(max(CASE WHEN ps > sim + 0.1::DOUBLE THEN ps ELSE sim END), 6) AS similarity FROM m GROUP BY 1, 2"""
    sql["half_and_half"] = f"""{FUSED}, a AS (SELECT qid, doc_id, sim AS s, {ranked.format(s='sim')} FROM sp), b AS (SELECT qid, doc_id, score AS s, {ranked.format(s='score')} FROM dn),
        u AS (SELECT *, 1 AS l FROM a WHERE rnk <= 4 UNION ALL SELECT *, 2 AS l FROM b WHERE rnk <= 3),
        n AS (SELECT qid, doc_id, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) WHEN s > 0 THEN 1.0 ELSE 0.0 END AS v FROM (SELECT *, min(s) OVER (PARTITION BY qid, l) AS lo, max(s) OVER (PARTITION BY qid, l) AS hi FROM u)),
        g AS (SELECT qid, doc_id, max(v) AS v FROM n GROUP BY qid, doc_id)
        SELECT qid, doc_id, rnk, round(v, 6) AS score FROM (SELECT *, {ranked.format(s='v')} FROM g) WHERE rnk <= 7"""
    sql["padded_results"] = f"WITH {bm25()}, {run(5)} SELECT b.item_id AS qid, CAST(i AS INTEGER) AS rnk, s.doc_id FROM benchmark b CROSS JOIN range(1, 9) t(i) LEFT JOIN sp s ON s.qid = b.item_id AND s.rnk = i"

    sql["sentence_window"] = f"""WITH s AS (SELECT doc_id, {sentences('text')} AS s FROM documents), e AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)
        SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, CAST(greatest(0, i - 1) AS INTEGER) AS window_start, CAST(least(len(s), i + 2) AS INTEGER) AS window_end, md5(s[i + 1]) AS sentence_md5,
        md5(array_to_string(s[greatest(0, i - 1) + 1 : least(len(s), i + 2)], ' ')) AS window_md5 FROM e"""
    sql["window_replace"] = "SELECT id, md5(coalesce(nullif(trim(answer), ''), question)) AS text_md5 FROM evaluations"
    sql["char_overlap_chunks"] = """SELECT doc_id, CAST(i // 320 AS INTEGER) AS chunk_index, CAST(i AS INTEGER) AS start, md5(substr(text, i + 1, 400)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 320)) AS i FROM documents)"""
    sql["adaptive_chunks"] = """WITH p AS (SELECT doc_id, text, CASE WHEN length(text) < 1000 THEN 200 WHEN length(text) < 5000 THEN 500 ELSE 1000 END AS n, CASE WHEN length(text) < 1000 THEN 50 WHEN length(text) < 5000 THEN 100 ELSE 200 END AS o FROM documents)
        SELECT doc_id, CAST(i // (n - o) AS INTEGER) AS chunk_index, CAST(i AS INTEGER) AS start, md5(substr(text, i + 1, n)) AS chunk_md5 FROM (SELECT *, unnest(range(0, length(text), n - o)) AS i FROM p)"""
    sql["table_row_blocks"] = """WITH c AS (SELECT *, c_custkey - (SELECT min(c_custkey) FROM customer) AS i FROM customer)
        SELECT CAST(i // 25 AS BIGINT) AS block, min(i) AS row_start, max(i) AS row_end, md5('c_custkey,c_name,c_nationkey' || chr(10) || string_agg(c_custkey || ',' || c_name || ',' || c_nationkey, chr(10) ORDER BY i)) AS chunk_md5 FROM c GROUP BY 1"""
    multi = f"""w AS (SELECT doc_id, {raw('text')} AS w FROM documents), l AS (SELECT * FROM (VALUES (0, 2048), (1, 512), (2, 128)) t(level, size)),
        e AS (SELECT doc_id, w, level, size, unnest(range(0, len(w), size)) AS i FROM w CROSS JOIN l WHERE len(w) > 0),
        m AS (SELECT doc_id, CAST(level AS INTEGER) AS level, CAST(i // size AS INTEGER) AS chunk_index, CAST(i AS INTEGER) AS start_word, CAST(least(len(w), i + size) AS INTEGER) AS end_word, array_to_string(w[i + 1 : i + size], ' ') AS chunk FROM e)"""
    sql["multilevel_chunks"] = f"WITH {multi} SELECT doc_id, level, chunk_index, start_word, end_word, substr(md5(doc_id || '_' || level || '_' || chunk_index), 1, 16) AS chunk_id, md5(chunk) AS chunk_md5 FROM m"
    sql["parent_child_join"] = f"WITH {multi} SELECT c.doc_id, c.level, c.chunk_index, p.chunk_index AS parent_index FROM m c JOIN m p ON c.doc_id = p.doc_id AND p.level = c.level - 1 AND c.start_word < p.end_word AND p.start_word < c.end_word"
    sql["markdown_headings"] = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM l)
        SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(length(regexp_extract(ls[i + 1], '^(#{1,6})[ \t]', 1)) AS INTEGER) AS level, trim(regexp_extract(ls[i + 1], '^#{1,6}[ \t]+([^\r]+)', 1)) AS title FROM e WHERE regexp_matches(ls[i + 1], '^#{1,6}[ \t]+\S')"""
    sql["text_formats"] = f"""SELECT doc_id, CASE WHEN starts_with(text, '#') OR contains(text, chr(10) || '#') THEN 'markdown' WHEN contains(text, 'Article') OR contains(text, 'Section') OR contains(text, '§') THEN 'legal' ELSE 'text' END AS format,
        CAST(greatest(1, len({raw('text')})) AS INTEGER) AS tokens FROM documents"""

    sql["exact_dedup"] = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL"
    sql["hash_ids"] = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents"
    sql["minhash_signatures"] = f"WITH {minhash()} SELECT doc_id, md5(s) AS signature_md5 FROM sg"
    sql["lsh_candidate_pairs"] = f"WITH {minhash()} SELECT a AS doc_id_a, b AS doc_id_b FROM cp"
    sql["dedup_pairs"] = f"WITH {_SIMILAR} SELECT a AS doc_id_a, b AS doc_id_b, round(similarity, 6) AS similarity FROM cp"
    sql["dedup_clusters"] = f"""WITH RECURSIVE {_SIMILAR}, {_LINKS}
        SELECT doc_id, cluster_id, first_value(doc_id) OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, doc_id) AS canonical FROM comp JOIN documents USING (doc_id)"""
    sql["dedup_stats"] = f"WITH RECURSIVE {_SIMILAR}, {_LINKS} SELECT n, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS n FROM comp GROUP BY cluster_id) GROUP BY n"
    edges = """u AS (SELECT vec_id, min(vector) AS v FROM vectors WHERE vec_id IS NOT NULL AND dim IN (32, 64) AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY vec_id),
        v AS (SELECT min(vec_id) AS id, v, len(v) AS k FROM u GROUP BY v),
        ed AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS weight FROM v a JOIN v b ON a.k = b.k AND a.id < b.id WHERE round(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 9) >= 0.92)"""
    sql["semantic_edges"] = f"WITH {edges} SELECT src, dst, round(weight, 6) AS weight FROM ed"
    sql["semantic_clusters"] = f"""WITH RECURSIVE {edges}, lk AS (SELECT src AS x, dst AS y FROM ed UNION SELECT dst, src FROM ed UNION SELECT v.id, u.vec_id FROM u JOIN v ON u.v = v.v UNION SELECT u.vec_id, v.id FROM u JOIN v ON u.v = v.v),
        reach(x, y) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.x, lk.y FROM reach r JOIN lk ON r.y = lk.x), comp AS (SELECT x AS vec_id, min(y) AS cluster_id FROM reach GROUP BY x),
        me AS (SELECT vec_id, length(text) AS metric FROM (SELECT vec_id, min(doc_id) AS doc_id FROM vectors WHERE doc_id IS NOT NULL GROUP BY vec_id) LEFT JOIN documents USING (doc_id))
        SELECT vec_id, cluster_id, first_value(vec_id) OVER (PARTITION BY cluster_id ORDER BY coalesce(metric, 0) DESC, vec_id) AS canonical, count(*) OVER (PARTITION BY cluster_id) AS size FROM comp LEFT JOIN me USING (vec_id)"""
    sql["table_groups"] = """WITH t AS (SELECT table_name AS name, string_agg(column_name, ',' ORDER BY column_name) AS columns, md5(string_agg(lower(column_name), ',' ORDER BY lower(column_name))) AS signature
            FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'conversations', 'messages', 'collections') GROUP BY table_name)
        SELECT signature, string_agg(name, ',' ORDER BY name) AS tables, any_value(columns) AS columns FROM t GROUP BY signature"""
    rough = _COS.format(a="q.qvec", b="r.z")
    sql["eval_degradation"] = f"""WITH {dense(STATED)}, v AS (SELECT vec_id, embedding AS e, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 7 AS s FROM embeddings),
        r AS (SELECT vec_id, list_transform(e, lambda x: round(CAST(x AS DOUBLE) / s) * s) AS z FROM v),
        ro AS (SELECT * FROM (SELECT q.qid, r.vec_id AS doc_id, row_number() OVER (PARTITION BY q.qid ORDER BY round({rough}, 6) DESC, r.vec_id) AS n FROM ({STATED}) q CROSS JOIN r) WHERE n <= 10),
        d AS (SELECT qid, 1.0::DOUBLE - count(ro.doc_id) / 10.0::DOUBLE AS d FROM dn LEFT JOIN ro USING (qid, doc_id) GROUP BY qid), m AS (SELECT avg(d) AS m FROM d)
        SELECT 10 AS k, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd, round(min(d), 6) AS least, round(max(d), 6) AS most, round(avg(CASE WHEN abs(d - m) <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS within FROM d CROSS JOIN m"""
    sql["dedup_results_by_content"] = f"""{base} SELECT qid, doc_id, rnk FROM (SELECT s.*, row_number() OVER (PARTITION BY qid, {clean('d.text')} ORDER BY rnk) AS n FROM sp s JOIN documents d USING (doc_id)) WHERE n = 1"""
    sql["dedup_results_by_cluster"] = f"""{base}, c AS (SELECT s.*, row_number() OVER (PARTITION BY qid, {clean('d.text')} ORDER BY rnk) AS n FROM sp s JOIN documents d USING (doc_id))
        SELECT qid, doc_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid, CASE WHEN doc_id % 7 <> 0 THEN doc_id // 10 ELSE doc_id END ORDER BY rnk) AS m FROM c WHERE n = 1) WHERE m = 1"""
    sql["cluster_representatives"] = """SELECT source || '/' || coalesce(lang, '?') AS cluster, arg_max(doc_id, length(text) * 1000000::BIGINT - doc_id) AS representative, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1"""

    sql["noise_assigned"] = f"""WITH v AS (SELECT vec_id AS doc_id, embedding AS e, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE CAST(label AS INTEGER) END AS c, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
        u AS (SELECT c, i, e[i] / n AS x FROM (SELECT c, e, n, unnest(range(1, len(e) + 1)) AS i FROM v WHERE c >= 0)), m AS (SELECT c, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY c, i), k AS (SELECT c, list(x ORDER BY i) AS z FROM m GROUP BY c),
        s AS (SELECT v.doc_id, k.c, row_number() OVER (PARTITION BY v.doc_id ORDER BY {_COS.format(a='v.e', b='k.z')} DESC, k.c) AS r FROM v JOIN k ON v.c < 0)
        SELECT doc_id, c AS cluster FROM v WHERE c >= 0 UNION ALL SELECT doc_id, c FROM s WHERE r = 1"""
    sql["scaffold_sequential"] = f"""WITH c AS (SELECT * REPLACE (coalesce(source, '(none)') AS source), {sentences('text')}[1] AS head, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS BIGINT) AS grp FROM documents),
        k AS (SELECT source, grp, coalesce(lang, '?') AS l, count(*) AS n FROM c GROUP BY 1, 2, 3), b AS (SELECT source, grp, l FROM (SELECT *, row_number() OVER (PARTITION BY source, grp ORDER BY n DESC, l) AS r FROM k) WHERE r = 1),
        f AS (SELECT source, grp, coalesce(lang, '?') AS l, min(doc_id) AS d FROM c GROUP BY 1, 2, 3), w AS (SELECT source, grp, string_agg(l, ',' ORDER BY d) AS keywords FROM f GROUP BY 1, 2),
        g AS (SELECT source, grp, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS chunk_ids, CAST(sum(length(text)) AS BIGINT) AS original_size FROM c GROUP BY 1, 2),
        t AS (SELECT source, grp, substr(string_agg(head, ' ' ORDER BY doc_id), 1, 500) AS s FROM (SELECT *, row_number() OVER (PARTITION BY source, grp ORDER BY doc_id) AS r FROM c WHERE head IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2)
        SELECT source, grp, chunk_ids, md5(s) AS summary_md5, keywords, l AS category, original_size, round(length(s) / CAST(greatest(original_size, 1) AS DOUBLE), 6) AS ratio FROM g JOIN t USING (source, grp) JOIN w USING (source, grp) JOIN b USING (source, grp)"""
    sql["scaffold_expand"] = f"""WITH s AS (SELECT vec_id // 5 AS g, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1), q AS ({STATED}),
        r AS (SELECT qid, g, {_COS.format(a='qvec', b='e')} AS sc, row_number() OVER (PARTITION BY qid ORDER BY round({_COS.format(a='qvec', b='e')}, 6) DESC, g) AS n FROM q CROSS JOIN s)
        SELECT qid, vec_id AS chunk_id, round(1.0::DOUBLE / (2.0::DOUBLE - sc), 6) AS scaffold FROM r JOIN embeddings ON vec_id // 5 = g WHERE n <= 5"""

    sql["containment_judgements"] = f"WITH {_QRELS} SELECT qid, doc_id FROM qrels"
    sql["eval_per_query"] = f"""WITH {bm25()}, {run(20)}, {_QRELS}, {metrics('sp', '5, 10, 20')} SELECT qid, k, n_relevant, CAST(hits AS INTEGER) AS hits, round(recall, 6) AS recall, round(recall_capped, 6) AS recall_capped, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, round(ndcg, 6) AS ndcg_exp, round(mrr, 6) AS mrr FROM pq"""
    sql["eval_summary"] = f"WITH {bm25()}, {run(20)}, {_QRELS}, {metrics('sp', '5, 10, 20')} SELECT k, count(*) AS queries, {_AVGS} FROM pq GROUP BY k"
    sql["eval_ablation"] = f"""{FUSED}, {rrf}, hy AS (SELECT qid, doc_id, rnk FROM (SELECT *, {ranked.format(s='score')} FROM ff) WHERE rnk <= 10), {_QRELS},
        rs AS (SELECT 'bm25' AS mode, qid, doc_id, rnk FROM sp UNION ALL SELECT 'dense', qid, doc_id, rnk FROM dn UNION ALL SELECT 'hybrid', qid, doc_id, rnk FROM hy), {metrics('rs', '10', 'mode')}
        SELECT mode, k, count(*) AS queries, {_AVGS} FROM pq GROUP BY mode, k"""

    sql["latency_percentiles"] = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"
    sql["rolling_latency_100"] = "SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events"
    sql["counters"] = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type"
    sql["cache_hit_rate"] = "SELECT retrieval_method, count(*) AS n, CAST(sum(CASE WHEN has_answer THEN 1 WHEN NOT has_answer THEN 0 END) AS BIGINT) AS hits, round(avg(response_time), 9) AS mean_time FROM evaluations GROUP BY retrieval_method"
    sql["semantic_cache_lookup"] = f"WITH {dense(STATED, '(SELECT * FROM embeddings WHERE vec_id % 2 = 1 AND vec_id <= 300)', 1)} SELECT qid, doc_id AS key, score FROM dn WHERE score >= 0.2"
    sql["cache_ttl_lru"] = "SELECT key, epoch_us(last) AS last_us FROM (SELECT user_id AS key, max(ts) AS last FROM events GROUP BY user_id) WHERE epoch_us(last) >= (SELECT (epoch_us(max(ts)) // 1000000 - 86400) * 1000000 FROM events) ORDER BY last DESC, key LIMIT 50"
    sql["trace_buffer"] = "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5"

    sql["collections_count"] = "SELECT c.id, c.name, count(d.doc_id) AS document_count FROM collections c LEFT JOIN documents d ON d.collection_id = c.id GROUP BY c.id, c.name"
    sql["chunks_per_source"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"
    sql["semi_fetch"] = "SELECT doc_id, id FROM documents WHERE doc_id IN (SELECT doc_id FROM vectors WHERE doc_id IS NOT NULL)"
    sql["resume_anti"] = "SELECT doc_id, id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM vectors WHERE doc_id IS NOT NULL)"
    sql["delete_cascade"] = """WITH m AS (SELECT doc_id, collection_id AS c FROM documents WHERE collection_id IS NOT NULL), l AS (SELECT c, count(*) AS n FROM m WHERE NOT (md5(c) < '6' OR doc_id % 2 = 0) GROUP BY c)
        SELECT id, coalesce(n, 0) AS n FROM collections LEFT JOIN l ON c = id WHERE n IS NOT NULL OR id NOT IN (SELECT c FROM m)"""
    sql["latest_wins"] = "SELECT id, role, epoch_us(received_at) AS received_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, coalesce(role, '') DESC) AS n FROM messages WHERE id IS NOT NULL) WHERE n = 1"
    sql["file_status_counts"] = "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type"
    sql["compaction_steps"] = "SELECT event_id, user_id % 3 AS priority FROM events WHERE event_type = 'click' ORDER BY user_id % 3 DESC, ts, event_id LIMIT 100"
    sql["vector_norms"] = "SELECT vec_id, stored_at, round(n, 5) AS norm FROM (SELECT vec_id, stored_at, CASE WHEN len(vector) = 0 THEN 0.0 ELSE sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) END AS n FROM vectors WHERE vector IS NOT NULL) WHERE n IS NOT NULL AND NOT isnan(n) AND n < 1e30"
    sql["questions_to_corpus"] = """WITH q AS (SELECT md5(question) AS qid, from_json(contexts, '["VARCHAR"]') AS ds FROM evaluations WHERE question IS NOT NULL), e AS (SELECT qid, md5(unnest(ds)) AS doc_id FROM q)
        SELECT DISTINCT 'corpus' AS part, doc_id AS id FROM e WHERE doc_id IS NOT NULL UNION ALL SELECT DISTINCT 'query', qid FROM q UNION ALL SELECT DISTINCT 'judgement', qid || '/' || doc_id FROM e WHERE doc_id IS NOT NULL"""
    sql["guessed_language"] = _guessed()
    sql["light_stems"] = _stems()
    sql["german_compound_split"] = _compounds()
    sql["enriched_chunks"] = rf"""WITH t AS (SELECT doc_id, {sentences('text')} AS s, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
        d AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(w) AS x FROM t) WHERE length(x) >= 5), k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, x) AS r FROM d),
        g AS (SELECT doc_id, string_agg(x, ',' ORDER BY r) AS keywords FROM k WHERE r <= 5 GROUP BY doc_id)
        SELECT t.doc_id, md5(s[1]) AS summary_md5, coalesce(keywords, '') AS keywords, CASE WHEN len(w) < 100 THEN 'short' WHEN len(w) < 400 THEN 'medium' ELSE 'long' END AS category,
        round(least(5.0, len(w) / 100.0::DOUBLE), 4) AS score FROM t LEFT JOIN g USING (doc_id)"""
    sql["audit_export"] = _audit()
    sql["p7_found"] = _log_entries()
    sql["citations"] = f"""WITH {bm25()}, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rnk FROM sc)
        SELECT qid, rnk, d.id AS chunk_id, coalesce(source, 'unknown') AS source_file, json_extract_string(metadata, '$.page') AS page, substr(text, 1, 200) AS snippet, round(score, 6) AS score FROM rk JOIN documents d USING (doc_id) WHERE rnk <= 10"""
    sql["date_range"] = "SELECT doc_id, strftime(created_at, '%Y-%m-%d') AS day FROM documents WHERE created_at >= TIMESTAMP '2025-03-01' AND created_at < TIMESTAMP '2025-04-01'"
    sql["query_scrub"] = "SELECT id, sha256(question) AS question_hash FROM evaluations"
    sql["sanitized_input"] = "SELECT id, md5(CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END) AS contexts_md5 FROM (SELECT id, replace(replace(contexts, chr(10), ' '), chr(13), ' ') AS t FROM evaluations)"
    sql["chat_template"] = """WITH o AS (SELECT conversation_id AS c, lower(trim(role)) AS r, content AS t, received_at AS ra, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at) AS n FROM messages WHERE conversation_id IS NOT NULL AND role IS NOT NULL AND content IS NOT NULL) WHERE n = 1),
        m AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY c ORDER BY ra, id), '') AS p FROM o),
        e AS (SELECT c, ra, id, r, '<|start_header_id|>' || r || '<|end_header_id|>' || chr(10) || chr(10) || t || '<|eot_id|>' AS a, '<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10) AS b,
            CASE r WHEN 'system' THEN '[INST] ' || t || chr(10) || chr(10) WHEN 'user' THEN CASE WHEN p = 'system' THEN '' ELSE '[INST] ' END || t || ' [/INST]' WHEN 'assistant' THEN ' ' || t || '</s>' ELSE '' END AS d FROM m)
        SELECT c AS conversation_id, md5('<|begin_of_text|>' || string_agg(a, '' ORDER BY ra, id) || CASE WHEN last(r ORDER BY ra, id) = 'user' THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE '' END) AS llama3_md5,
            md5('<s>' || string_agg(d, '' ORDER BY ra, id)) AS mistral_md5, md5(string_agg(b, '' ORDER BY ra, id) || CASE WHEN last(r ORDER BY ra, id) = 'user' THEN '<|im_start|>assistant' || chr(10) ELSE '' END) AS chatml_md5, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY c"""
    sql["question_contexts"] = """SELECT id, md5('Context:' || chr(10) || array_to_string(from_json(contexts, '["VARCHAR"]'), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || question) AS message_md5 FROM evaluations WHERE question IS NOT NULL"""
    sql["chunk_id_migration"] = "SELECT id, new_id FROM (SELECT id, regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9._:-]', '_', 'g') || '_p' || (doc_id % 7) || '_chunk_' || doc_id AS new_id FROM documents) WHERE id <> new_id"
    sql["sanitize_ids"] = "SELECT DISTINCT logfile, regexp_matches(logfile, '^[A-Za-z0-9_.:-]+$') AS valid, regexp_replace(logfile, '[^A-Za-z0-9._:-]', '_', 'g') AS clean FROM logs_fts"
    sql["metadata_values"] = "SELECT client, count(*) AS n FROM (SELECT json_extract_string(metadata, '$.client') AS client FROM messages) WHERE client IN ('cli', 'api') GROUP BY client"
    sql["page_of_documents"] = "SELECT doc_id FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40"
    sql["set_operations"] = """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM vectors) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM vectors)"""

    sql["clean_text"] = f"SELECT doc_id, md5({clean('text')}) AS clean_md5 FROM documents"
    plain = r"regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}]', '', 'g')"
    sql["preprocess_text"] = f"SELECT doc_id, md5({clean(plain)}) AS plain_md5 FROM documents"
    sql["tokenize"] = f"SELECT doc_id, CAST(len({tok('text')}) AS INTEGER) AS n, md5(array_to_string({tok('text')}, ' ')) AS tokens_md5 FROM documents"
    sql["keyword_parse"] = r"""WITH p AS (SELECT id, list_filter(list_transform(string_split_regex(answer, '[;,\n|]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM evaluations WHERE answer IS NOT NULL)
        SELECT id, md5(array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '#')) AS keywords_md5 FROM p"""
    sql["sealed_round_trip"] = "SELECT item_id AS qid, true AS same FROM benchmark"
    sql["smart_sample"] = f"""WITH {_QRELS}, r AS (SELECT DISTINCT doc_id FROM qrels), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r))
        SELECT doc_id FROM r UNION ALL SELECT doc_id FROM o WHERE n <= greatest(0, 500 - (SELECT count(*) FROM r))"""
    sql["response_lines"] = f"""WITH {bm25()}, {run(3)} SELECT qid, rnk AS seq, 'source' AS type, doc_id, score, CAST(NULL AS BIGINT) AS n FROM sp
        UNION ALL SELECT qid, CAST(max(rnk) + 1 AS INTEGER), 'done', NULL, NULL, count(*) FROM sp GROUP BY qid"""
    return sql
