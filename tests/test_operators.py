import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions import stemming, templates, text
from papyrine.operators import catalog, chunking, dedup, dense, evaluate, fusion, graph, rerank, routing, scaffold, sparse
from papyrine.plans import layout, ordered, queries
from papyrine.plans.ordered import lag_across, running_sum


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("t,want", [("a \n b c ", "a b c"), ("", ""), (None, None)])
def test_clean_text(spark, t, want):
    assert one(spark, t, text.clean_text) == want


def test_tokens_and_counts(spark):
    assert one(spark, "Élan, a x_1 42!", text.tokens) == ["élan", "x_1", "42"]
    assert one(spark, "  ", text.token_count) == 1


def test_sentences_keep_abbreviations(spark):
    assert one(spark, "See Dr. Ode, e.g. now.  Then go! No. 5 ends", text.sentences) == ["See Dr. Ode, e.g. now.", "Then go!", "No. 5 ends"]
    assert chunking.sentences_of("See Dr. Ode, e.g. now.  Then go! No. 5 ends") == ["See Dr. Ode, e.g. now.", "Then go!", "No. 5 ends"]


def test_keywords_and_ids(spark):
    assert one(spark, "Tax; tax,law|\n Law , x", text.keyword_list) == ["Tax", "law", "x"]
    assert one(spark, "a/b c", text.sanitize_id) == "a_b_c"
    assert one(spark, "Query: 'abc'", text.scrub_log_line).startswith("Query: '") and "abc" not in one(spark, "Query: 'abc'", text.scrub_log_line)
    assert one(spark, "line\n" * 300, text.sanitize_input).endswith("...")
    assert one(spark, "der und die", text.guess_language) == "de" and one(spark, "zzz", text.guess_language) == "en"


def test_stems_and_compounds(spark):
    stem = lambda w, k: one(spark, w, lambda c: stemming.light_stem(c, F.lit(k)))
    parts = lambda w: one(spark, w, stemming.compound_parts)
    assert stem("gatti", "it") == stem("gatto", "it") == "gatt" and stem("walks", "xx") == "walks" and stem("ties", "en") == "ties"
    assert parts("Datenschutzgrundverordnung") == ["datenschutzgrundverordnung", "datenschutz", "grund", "verordnung"]
    assert parts("kurz") == ["kurz"] and parts("Umsatzsteuer") == ["umsatzsteuer", "umsatz", "steuer"]
    assert parts("Arbeitsvertrag") == ["arbeitsvertrag", "arbeitsv", "rtrag"] and parts("Rathausplatz") == ["rathausplatz", "rathau", "platz"]
    assert parts("rockwahlquiz") == ["rockwahlquiz", "roc", "kwahlq", "uiz"] and parts("aaabbbbcccdddd") == ["aaabbbbcccdddd"]


def test_plain_nodes():
    t = "I. early\nx\n1. Intro\na\nII. mid\nb\nTITLE ONE\nc\n2. Later\nd\nTITLE TWO\ne\n"
    got = [(n.level, n.title) for n in chunking.plain_nodes(t)]
    assert got == [(1, "TITLE ONE"), (1, "TITLE TWO")]
    assert [(n.level, n.title) for n in chunking.plain_nodes("1. One\na\n2. Two\nI. x\n3. Three\n")] == [(2, "1. One"), (2, "2. Two"), (2, "3. Three")]
    assert [(n.level, n.title) for n in chunking.plain_nodes("I. x\nII. y\n1. One\nb\n")] == [(3, "I. x"), (2, "1. One")]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, vs in {"a": rng.lognormal(0, 2, 5000), "b": np.repeat([1.0, 2.0], [30, 70]), "c": [7.0]}.items() for v in vs] + [("c", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ordered.exact_percentiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    for k in "abc":
        v = [x for g, x in rows if g == k and x is not None]
        assert got[k].n == len(v) and np.allclose([got[k].p0, got[k].p50, got[k].p99, got[k].p100], np.percentile(v, [0, 50, 99, 100]))


def test_no_plan_orders_all_rows(spark):
    v = spark.range(1000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0)).alias("embedding"))
    t = dense.hot_cold(v)
    assert t.where("tier = 'hot'").agg(F.max("doc_id")).first()[0] == 199 and t.where("tier = 'hot'").count() == 200
    assert "TakeOrdered" not in t._jdf.queryExecution().executedPlan().toString()
    assert dense.hot_cold(v.limit(1)).first().tier == "hot" and dense.hot_cold(v.limit(0)).count() == 0
    g = scaffold.sequential_groups(v.withColumn("source", F.lit("s")), "source", "doc_id")
    assert sorted((r.grp, r["count"]) for r in g.groupBy("grp").count().collect()) == [(i, 5) for i in range(200)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "I love apples and bananas."), (2, "I drive a car."), (3, None), (4, "apples apples bananas apples"), (5, "apples")], "doc_id long, text string")
    got = sparse.search(docs, spark.createDataFrame([(9, "apples"), (8, None), (7, "zzz")], "qid long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 4, 5} and {r.qid for r in got} == {9}
    s = {r.doc_id: r.score for r in got}
    assert s[4] > s[1]
    only = sparse.search(docs, spark.createDataFrame([(9, "apples")], "qid long, text string"), allowed=spark.createDataFrame([(5,)], "doc_id long")).collect()
    assert [(r.doc_id, r.score) for r in only] == [(5, s[5])]


def test_search_in_blocks_of_words(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text_of = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 60, n))
    docs = spark.createDataFrame([(i, text_of(30)) for i in range(80)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text_of(8)) for i in range(12)], "qid long, text string")
    whole = [tuple(r) for r in sparse.search(docs, asked, 5).orderBy("qid", "rnk").collect()]
    monkeypatch.setattr(sparse, "CELLS", 40)
    assert len(list(sparse._blocks({1: [(0, 1)] * 3, 2: [(i, 1) for i in range(30)], 3: [(5, 1)]}))) == 3
    assert [tuple(r) for r in sparse.search(docs, asked, 5).orderBy("qid", "rnk").collect()] == whole


def test_fusion_ranks(spark):
    lists = [(1, 1, 2), (2, 3, 1), (3, 5, 4)]
    d = spark.createDataFrame([(0, a, b) for a, b, _ in lists], "qid int, doc_id int, rnk int")
    s = spark.createDataFrame([(0, a, c) for a, _, c in lists], "qid int, doc_id int, rnk int")
    got = fusion.combine(s, d, 3, 60, 1.0, 1.0).orderBy("rnk").collect()
    assert got[0].doc_id == 1 and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12


@pytest.mark.parametrize("v,want", [([0, 1, 2], [0, 0.5, 1]), ([2, 2], [1, 1]), ([0, 0], [0, 0])])
def test_min_max(spark, v, want):
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "qid int, doc_id int, score double")
    assert [r.n for r in df.select("doc_id", fusion.min_max(F.col("score")).alias("n")).orderBy("doc_id").collect()] == want


def test_rank_norm(spark):
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([10, 5, 0])], "qid int, doc_id int, score double")
    assert [r.n for r in df.select("doc_id", fusion.rank_normalised(F.col("score"), F.col("doc_id")).alias("n")).orderBy("doc_id").collect()] == [1, 0.5, 0]


@pytest.mark.parametrize("q,label", [("What is the capital of France?", "factual"), ("apple vs banana", "comparative"), ("overview of it", "exploratory"), ("When did it end?", "temporal"), ("How does it work?", "conceptual"), ("", "exploratory")])
def test_routing(spark, q, label):
    assert one(spark, q, lambda c: routing.classify(c)["label"]) == label


def test_alpha(spark):
    r = spark.range(1).select(routing.adaptive_alpha(F.lit(0.5), F.lit(True), F.lit(0.035), F.lit(1.75)).alias("a"), routing.adaptive_alpha(F.lit(0.5), F.lit(True), F.lit(None), F.lit(None)).alias("b")).first()
    assert abs(r.a - 0.43875) < 1e-12 and abs(r.b - 0.35) < 1e-12


def test_temporal(spark):
    f = lambda q: one(spark, q, lambda c: routing.temporal_range(c, F.lit("2025-03-31").cast("date"))["start"].cast("string"))
    assert f("from 2019-2021") == "2019-01-01" and f("in 2020") == "2020-01-01" and f("last 2 months") == "2025-01-30" and f("none") is None


def test_structure():
    n = chunking.markdown_nodes("# Article 5\n## Paragraph 1\n## Paragraph 2\n### Subparagraph\n")
    assert [x.level for x in n] == [1, 2, 2, 3]
    assert chunking.paths(n)[-1] == ["Article 5", "Paragraph 2", "Subparagraph"]
    legal = chunking.legal_nodes("Article 1 - One\ntext\nSection 2: Two\nmore\nArticle 3 - Three\n")
    assert [(x.kind, x.numbering) for x in legal] == [("article", "1"), ("section", "2"), ("article", "3")]
    assert legal[1].end == legal[2].start == legal[0].end or legal[1].end == legal[2].start


def test_packing_keeps_limits():
    t = "\n\n".join(" ".join(f"Sentence {i} of part {p} is here." for i in range(12)) for p in range(4))
    parts = chunking.pack(t, 300, 50)
    assert len(parts) > 3 and all(len(x) <= 340 for x in parts)
    assert parts[1].split(". ")[0] in parts[0]
    assert chunking.pack("", 300) == [] and chunking.pack("short", 300, 100) == ["short"]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.overlap_chunks(spark.createDataFrame([(1, "x")], "doc_id int, text string"), 10, 10)


def test_parents_cover_children(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(3000)))), (2, ""), (3, None)], "doc_id long, text string")
    c = chunking.word_level_chunks(docs)
    got = chunking.parents(c).where("level = 2").collect()
    assert {(r.chunk_index, r.parent_index) for r in got} == {(i, i // 4) for i in range(24)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 2), *[(100 + i, 101 + i) for i in range(40)]], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got[3] == 1 and got[9] == 8 and got[5] == 5 and got[140] == 100
    assert graph.connected_components(e.limit(0)).count() == 0


def test_groups_of_copies(spark):
    base = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " tail"), (4, "quite another text with few words"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.cluster_id, r.canonical) for r in dedup.verified_groups(docs).collect()}
    assert got[1] == got[2] == got[3] == (1, 3) and got[4] == (4, 4) and got[5] == (5, 5)
    assert {(r.doc_id, r.copies) for r in dedup.exact_groups(docs).collect()} == {(1, 2), (2, 2), (3, 1), (4, 1), (6, 1)}


def _edited(n=120):
    """Texts in families of four whose members are edited ever more, the first as the source."""
    rng = np.random.default_rng(3)
    rows = []
    for f in range(n):
        w = [f"f{f}w{i}" for i in range(200)]
        for k in range(4):
            t = list(w)
            for i in rng.choice(200, k * 2, replace=False):
                t[i] = f"x{f}k{k}i{i}"
            rows.append((4 * f + k, " ".join(t)))
    return rows


def test_verified_pairs_equal_brute_force(spark):
    rows = _edited()
    sets = {i: set(dedup.shingle_hashes(t)) for i, t in rows}
    want = {}
    for f in range(0, len(rows), 4):
        for a in range(f, f + 4):
            for b in range(a + 1, f + 4):
                s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if s >= 0.8:
                    want[a, b] = round(s, 9)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, rows[0][1])], "doc_id long, text string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in dedup.verified_pairs(docs).collect()}
    assert len(want) > 100 and got == want
    groups = {r.doc_id: r.cluster_id for r in dedup.verified_groups(docs).collect()}
    assert len(groups) == len(rows) + 3 and groups[9002] == 0 and all(groups[a] == groups[b] for a, b in want)


@pytest.mark.parametrize("block", [256, 5])
def test_every_pair_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    # Ids under 30 share the first band only, 100 and 101 the last, 200 none.
    rows = [(i, [0] * 4 + [1000 * i + j for j in range(113)]) for i in range(30)]
    rows += [(i, [1000 * i + j for j in range(112)] + [7] * 4 + [i]) for i in (100, 101)] + [(200, list(range(10**6, 10**6 + 117)))]
    got = [(r.a, r.b) for r in dedup.all_candidate_pairs(spark.createDataFrame(rows, "doc_id long, signature array<long>")).collect()]
    assert sorted(got) == [(a, b) for a in range(30) for b in range(a + 1, 30)] + [(100, 101)]


def test_bands_follow_the_number_of_vectors():
    for n in (10, 50_000, 10**9):
        bands, bits = dense.bands_for(0.92, n)
        assert (1 - (1 - np.arccos(0.92) / np.pi) ** bits) ** bands <= dense.MISSED and n / 2**bits <= 1


def test_semantic_edges_of_all_dims(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        dim = 32 if i % 3 else 64
        v = rng.standard_normal(dim) if i % 9 < 3 else np.array(rows[i - 3][1]) + 0.2 * rng.standard_normal(dim)
        rows.append((i, [float(x) for x in v], dim))
    bad = [(900, None, 32), (901, [0.0] * 32, 32), (902, [float("nan")] * 32, 32), (903, [1.0] * 31, 32), (904, [1.0] * 32, None), (905, [1.0] * 32, 64)]
    spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, vector array<float>, dim int, stored_at long").write.parquet(f"{tmp_path}/vectors.parquet")
    want = set()
    for a, x, _ in rows:
        for b, y, _ in rows[a + 1 :]:
            if len(x) == len(y):
                x_, y_ = np.float32(x).astype(float), np.float32(y).astype(float)
                if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.92:
                    want.add((a, b))
    assert {len(rows[a][1]) for a, _ in want} == {32, 64}
    assert {(r.src, r.dst) for r in queries.semantic_edges(spark, str(tmp_path)).collect()} == want


def test_dense_and_edges(spark):
    v = spark.createDataFrame([(1, [0.99, 0.01]), (2, [0.98, 0.02]), (3, [0.0, 1.0]), (4, None), (5, [0.99, 0.01]), (6, [0.0, 0.0])], "doc_id long, embedding array<float>")
    assert [(r.src, r.dst) for r in dense.semantic_edges(v.where("doc_id != 6"), 0.9).collect()] == [(1, 2)]
    assert {(r.rep, r.id) for r in dense.representatives(v).collect()} >= {(1, 1), (1, 5)}
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    assert [r.doc_id for r in dense.cosine_top_k(v, q, 2).orderBy("rnk").collect()] == [1, 5]


def test_ivf_and_pq(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(200)], "doc_id long, embedding array<float>")
    ix, c = dense.ivf_lists(v, 4)
    q = v.where("doc_id < 5").selectExpr("doc_id qid", "embedding qvec")
    full = {(r.qid, r.doc_id) for r in dense.cosine_top_k(v, q, 5).collect()}
    assert {(r.qid, r.doc_id) for r in dense.ivf_search(ix, c, q, 5, probes=4).collect()} == full
    assert dense.pq_codes(v, 3, 4).select(F.size("pq")).first()[0] == 2


def test_metrics(spark):
    rel = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (1, 12, 1), (2, 5, 1)], "qid int, doc_id int, rel int")
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 99, 3), (1, 98, 4)], "qid int, doc_id int, rnk int")
    m = {(r.qid, r.k): r for r in evaluate.per_query(run, rel, (4,)).collect()}
    assert abs(m[1, 4].recall - 2 / 3) < 1e-9 and m[1, 4].precision == 0.5 and m[1, 4].mrr == 1.0
    assert m[2, 4].recall == 0.0 and m[2, 4].ndcg == 0.0
    ideal = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, doc_id int, rnk int")
    assert abs(evaluate.per_query(ideal, rel.where("qid = 1"), (4,)).first().ndcg - 1) < 1e-9


def test_merge_to_parents(spark):
    leaves = spark.createDataFrame([(0, "a", 0.5, "p"), (0, "b", 0.7, "q")], "qid int, doc_id string, similarity double, parent_id string")
    parents = spark.createDataFrame([(0, "p", 0.9), (0, "q", 0.75)], "qid int, parent_id string, parent_similarity double")
    assert {(r.doc_id, r.similarity) for r in rerank.merge_to_parents(leaves, parents).collect()} == {("p", 0.9), ("b", 0.7)}


def test_windows_over_chunks(spark):
    df = spark.createDataFrame([("g", i // 3, i, i * i) for i in range(10)], "g string, chunk int, i int, v int")
    got = lag_across(df, ["g"], "chunk", ["i"], ["v"], "p").orderBy("i").collect()
    assert [r.p.v if r.p else None for r in got] == [None, *[i * i for i in range(9)]]
    sums = running_sum(df, ["g"], "chunk", ["i"], F.lit(1), "n").orderBy("i").collect()
    assert [r.n for r in sums] == list(range(1, 11))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(5):
        catalog.publish(spark.range(i + 1), root, now=1000.0 + i)
    assert len(catalog.versions(spark, root)) == 3 and catalog.current(spark, root).count() == 5
    catalog.rollback(spark, root)
    assert catalog.current(spark, root).count() == 4


def test_delete_cascade(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id int, collection_id string")
    c = spark.createDataFrame([("a",), ("b",), ("empty",)], "id string")
    left, kept = catalog.delete_cascade(m, c, spark.createDataFrame([(3,)], "doc_id int"))
    assert left.count() == 2 and {r.id for r in kept.collect()} == {"a", "empty"}


def test_scaffold_of_empty(spark):
    c = spark.createDataFrame([], "doc_id int, source string, summary string, keywords array<string>, category string, n int")
    assert scaffold.roll_up(scaffold.sequential_groups(c, "source", "doc_id"), ["source", "grp"], "doc_id", "summary", "keywords", "category", "n").count() == 0


def test_prompts(spark):
    m = spark.createDataFrame([([("system", "be nice"), ("user", "hi"), ("assistant", "hello"), ("user", "more")],), ([],)], "ms array<struct<role:string,content:string>>")
    got = m.select(*[templates.render(F.col("ms"), k).alias(k) for k in templates.STYLES]).collect()
    assert got[0].mistral == "<s>[INST] be nice\n\nhi [/INST] hello</s>[INST] more [/INST]"
    assert got[0].chatml.endswith("<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\n")
    assert got[0].default == "System: be nice\n\nUser: hi\n\nAssistant: hello\n\nUser: more\n\nAssistant: "
    assert got[0].llama3.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nbe nice<|eot_id|>") and got[1].mistral == "<s>"
    with pytest.raises(ValueError):
        templates.render(F.col("ms"), "none")


def test_ids_of_metadata(spark):
    r = spark.range(1).select(templates.known_id(F.lit(""), F.lit(None), F.lit("x")).alias("a"), templates.first_with_id(F.expr("array(named_struct('id', cast(null as string)), named_struct('id', 'q'))"))["id"].alias("b"), templates.context_of(F.array(F.lit("a"), F.lit(None), F.lit("b"))).alias("c")).first()
    assert (r.a, r.b, r.c) == ("x", "q", "a\n\nb")


def test_rolling_mean_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 10)
    rows = [("a", i, float(i * i % 17)) for i in range(57)] + [("b", i, 1.0) for i in range(3)]
    got = ordered.rolling_mean(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], ["i"], "v", 7, "m").orderBy("g", "i").collect()
    want = [np.mean([v for g2, j, v in rows if g2 == g and i - 7 < j <= i]) for g, i, _ in rows]
    assert np.allclose([r.m for r in got], want)
    assert ordered.rolling_mean(spark.createDataFrame([], "g string, i int, v double"), ["g"], ["i"], "v", 7, "m").count() == 0


def test_written_tables_need_a_shared_folder(spark, tmp_path, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        layout.shared_dir(Session())


def test_written_tables_go(spark):
    import os

    t = layout.cut(spark.range(5))
    where = t._written.removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(where) and spark.sparkContext.applicationId in where
    layout.drop(t)
    assert not os.path.exists(where)


def test_spread_reads_nodes_and_not_names(spark, tmp_path):
    at = str(tmp_path / "Sorted Limit")
    spark.range(10).withColumnRenamed("id", "Join").coalesce(1).write.parquet(at)
    assert layout.spread(spark.read.parquet(at), 3).rdd.getNumPartitions() == 3
    assert layout.spread(spark.read.parquet(at).groupBy("Join").count(), 3).rdd.getNumPartitions() >= 1
