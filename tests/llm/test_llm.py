"""The training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import conversations, encodings, langid, languages, leakage, near_duplicates, neighbours, packing, pairs, queries, shingles, splitting
from papyrine.plans.layout import table

DOC = "doc_id long, text string, lang string, source string, label string, seg_no string, piece string, rank string, container string"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, "x", "x", "x", "x", "x") for i, t, lang, s in rows], DOC)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return languages.fit(table(spark, sf_dir, "lang_samples"))


# -- 1 -------------------------------------------------------------------------------------------


def test_language_held_out(spark, sf_dir):
    rows = [(r.lang, r.text) for r in table(spark, sf_dir, "lang_samples").orderBy("sample_id").collect()]
    m = langid.train([r for i, r in enumerate(rows) if i % 3])
    held = [r for i, r in enumerate(rows) if not i % 3]
    right = sum(max(langid.stretches(m, t), key=lambda s: s[4] - s[3])[1] == k for k, t in held)
    assert right >= 0.97 * len(held)


def test_language_segments(spark, model):
    en = "The retention policy describes the service agreement within thirty working days. "
    de = "Die Dienstvereinbarung beschreibt die Aufbewahrungsfrist ohne weitere Ankündigung. "
    long = en * 3000
    rows = [(1, en, "EN ", "s"), (2, en + de + en, "en", "s"), (3, de, "eng", None), (4, None, "en", "s"), (5, "", "en", "s"), (6, "12 / 34", "en", "s"), (7, de, "Deutsch", "s"), (8, long, "en-GB", "s"), (7, de, "Deutsch", "s"), (9, en, None, "s")]
    seg = languages.language_segments(docs(spark, rows), model)
    got = {}
    for r in seg.orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append(r.lang)
        assert 0.0 <= r.confidence <= 1.0
    assert got[1] == ["en"] and got[2] == ["en", "de", "en"] and got[3] == ["de"] and got[7] == ["de", "de"] and got[8] == ["en"]
    assert not {4, 5} & set(got)
    found = {(r.doc_id, r.seg_no, r.lang) for r in languages.wrong_labels(seg).collect() if r.doc_id != 6}
    assert found == {(2, 0, "en"), (2, 1, "de"), (2, 2, "en"), (3, 0, "de"), (9, 0, "en")}
    assert languages.wrong_labels(languages.language_segments(docs(spark, []), model)).count() == 0


def test_quick_and_close_look_agree(spark, sf_dir, model):
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    quick = langid.stretches_many(model, texts)
    assert sum([s[1] for s in q] != [s[1] for s in langid.stretches(model, t)] for q, t in zip(quick, texts)) <= len(texts) // 500


# -- 2 -------------------------------------------------------------------------------------------

Q = "Which deadline applies to the audit trail of Rakan?"
OPEN = frozenset("the of within and for".split())


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"), ("", "empty"), ("​ \n", "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("```\n```", "empty"), ("[]", "empty"), ("...", "empty"),
        (Q, "copy"), ("You asked: " + Q.upper(), "copy"), (Q + " " + Q, "copy"), (Q + " The audit trail ends on the last day of the month.", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Hello Ann, As an assistant, I cannot provide this kind of information :(\n\nKind regards", "refusal"), ("**Unfortunately I must decline this request.**", "refusal"),
        ("The supplier refused to sign, and the office could not help with the appeal.", None),
        ("Die Dienstvereinbarung beschreibt die Aufbewahrungsfrist ohne weitere Ankündigung.", "language"),
        ("The audit trail of Rakan ends within the", "truncated"), ("The audit trail ends. The lease con", "truncated"), ("1. The audit trail ends.\n2.", "truncated"), ("The audit trail ends.\n```json\n{\"a\": 1", "truncated"), ("The audit trail…", "truncated"),
        ("- the audit trail\n- the lease contract", None), ("30 days", None), ("€12", None), ("the audit trail of Rakan", None), ("The audit trail ends within 30 days [1]", None), ("The audit trail ends within 30 days ✓", None), ("The audit trail ends.\n```json\n{\"a\": 1}\n```", None),
    ],
)
def test_defects(model, answer, want):
    assert pairs.defect_of(Q, answer, model, OPEN) == want


def test_language_that_was_asked_for(model):
    assert pairs.defect_of(Q + " Please answer in German.", "Die Dienstvereinbarung beschreibt die Aufbewahrungsfrist ohne weitere Ankündigung.", model, OPEN) is None


def test_pairs_table(spark, model):
    schema = "id long, question string, answer string, contexts string, defect string, word string"
    rows = [(1, Q, None, None, "x", "x"), (2, None, "I cannot answer this.", "[]", "x", "x"), (2, None, "I cannot answer this.", "[]", "x", "x"), (3, Q, "It ends in May. " * 20000, None, None, None)]
    got = sorted((r.id, r.defect) for r in pairs.defective_pairs(spark.createDataFrame(rows, schema), model).collect())
    assert got == [(1, "empty"), (2, "refusal"), (2, "refusal")]
    assert pairs.defective_pairs(spark.createDataFrame([], schema), model).count() == 0


def test_longest_common_run_of_words():
    rng = random.Random(1)

    def slow(a, q):
        best = (0, 0)
        for i in range(len(a)):
            for j in range(len(q)):
                n = 0
                while i + n < len(a) and j + n < len(q) and a[i + n] == q[j + n]:
                    n += 1
                best = max(best, (n, -i))
        return best[0], -best[1]

    for _ in range(200):
        a, q = ([rng.choice("abcd") for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert pairs._block(a, q) == slow(a, q)
    long = [str(rng.randrange(9)) for _ in range(60_000)]
    assert pairs._block(["x", *long[100:50_000]], long) == (49_900, 1)


def test_a_long_copy_is_a_copy(model):
    assert pairs.defect_of(Q, " ".join([Q] * 40), model, OPEN) == "copy"


def test_open_words_are_not_cut_off(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SEEN", 2)
    monkeypatch.setattr(pairs, "LEAST_SHARE", 1e-9)
    # More words than any fixed number would keep, each twice and never last.
    names = [f"w{i:05d}" for i in range(25_000)]
    rows = [(i, "q", " ".join(names) + " end.", None) for i in range(2)]
    got = pairs.never_ending_words(spark.createDataFrame(rows, "id long, question string, answer string, contexts string"))
    assert got.count() == 25_000 and got.where("word = 'end'").isEmpty()


# -- 3 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_pieces_round_trip(spark, seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(["word ", "longer😀\xa0", "end. ", "\n", "\n\n", "x" * rng.choice([5, 1790, 1850, 2000, 2001, 4500]) + " "]) for _ in range(rng.choice([3, 40, 900])))
    rows = [(i, make(), "en", "s") for i in range(12)] + [(90, None, "en", "s"), (91, "", "en", "s"), (92, "a" * 2000, "en", "s"), (93, "a" * 2001, "en", "s"), (94, " " * 5000, "en", "s"), (96, "c" * 1500 + "\xa0" + "d" * 1500, "en", "s"), (95, "é" * 1999 + " " + "b" * 1999, "en", "s")]
    texts = {i: t for i, t, *_ in rows}
    pieces = splitting.split_pieces(docs(spark, rows))
    got = {}
    for r in pieces.orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, t in texts.items() if t and len(t) > 2000}
    for i, ps in got.items():
        at = 0
        for p in ps:
            assert 0 < len(p.piece) <= 2000 and 0 <= p.overlap <= 200
            assert p.first_char + p.overlap == at and texts[i][p.first_char : p.first_char + len(p.piece)] == p.piece
            at = p.first_char + len(p.piece)
        assert at == len(texts[i])
    import re

    forced = {r.doc_id: r.forced for r in splitting.oversized(pieces).collect()}
    assert forced == {i: int(bool(re.search(r"\S{2001}", t))) for i, t in texts.items() if i in got}


def test_splitting_is_linear(spark):
    import time

    def seconds(n):
        t = "".join(random.Random(n).choices(["wörd ", "longer ", "end. ", "\n"], k=n))
        df = docs(spark, [(1, t, "en", "s")])
        began = time.time()
        got = splitting.split_pieces(df).agg(F.sum(F.char_length("piece") - F.col("overlap")).alias("n")).first().n
        assert got == len(t)
        return time.time() - began

    seconds(20_000)
    assert seconds(1_600_000) < 8 * seconds(400_000) + 1


@pytest.mark.parametrize("limit,overlap", [(40, 20), (41, 0), (60, 7)])
def test_pieces_of_other_sizes(spark, limit, overlap):
    rng = random.Random(limit)
    texts = {i: "".join(rng.choice(["a ", "bb\n", "ccc. ", "\n\n", "d" * rng.choice([3, limit - 1, limit, limit + 1]) + " "]) for _ in range(80)) for i in range(8)}
    at = {}
    for r in splitting.split_pieces(docs(spark, [(i, t, "en", "s") for i, t in texts.items()]), limit, overlap).orderBy("doc_id", "piece_no").collect():
        assert 0 < len(r.piece) <= limit and r.overlap <= overlap and r.first_char + r.overlap == at.get(r.doc_id, 0)
        assert texts[r.doc_id][r.first_char : r.first_char + len(r.piece)] == r.piece
        at[r.doc_id] = r.first_char + len(r.piece)
    assert at == {i: len(t) for i, t in texts.items()}


# -- 4 -------------------------------------------------------------------------------------------


def brute_pairs(texts, threshold):
    sets = {}
    for i, t in texts.items():
        w = shingles.words_of(t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(40):
        w = list(base if i % 2 else [f"v{i}{j}" for j in range(30)])
        if i % 2:
            for _ in range(i % 7):
                w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(100, rows[1][1].upper().replace(" ", ", "), "en", "s"), (101, rows[1][1], "en", "s"), (102, None, None, None), (103, "", "en", "s"), (104, "one two three", "en", "s"), (101, rows[1][1], "en", "s"), (105, " ".join(f"z{i}" for i in range(60000)), "en", "s")]
    members, links = near_duplicates.similar_pairs(docs(spark, rows), 0.5)
    got = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.all_pairs(members, links).collect()}
    assert got == brute_pairs({i: t for i, t, *_ in rows}, 0.5)
    groups = {r.doc_id: r.group_id for r in near_duplicates.duplicate_groups(members, links).collect()}
    assert groups[101] == groups[1] == groups[100] and groups[0] == 0 and 102 not in groups
    members, links = near_duplicates.similar_pairs(docs(spark, []), 0.5)
    assert near_duplicates.all_pairs(members, links).count() == 0


def test_stop_table_never_drops_a_likely_pair():
    t = near_duplicates.stop_table(0.5)
    assert (np.diff(t) > 0).all() and t[-1] < 0.35 * near_duplicates.SIGNATURE


# -- 5 -------------------------------------------------------------------------------------------

VEC = "vec_id long, vector array<float>, dim int, stored_at timestamp, rep string, h string, neighbour string"


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, d, datetime(2025, 1, 1 + k % 28), "x", "x", "x") for k, (i, v, d) in enumerate(rows)], VEC)


def test_neighbours_exact_on_small(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 32)).astype(np.float32)
    x[60:] = x[:60] * 2
    x[100:] = x[0]
    rows = [(i, v.tolist(), 32) for i, v in enumerate(x)]
    bad = [(500, None, 32), (501, [0.0] * 32, 32), (502, [float("nan")] * 32, 32), (503, [1.0] * 31, 32), (504, [1.0] * 32, None), (505, [1.0] * 16, 16), (None, [1.0] * 32, 32), (506, [float("inf")] + [1.0] * 31, 32), (507, [None] + [1.0] * 31, 32), (508, [], 0)]
    got = neighbours.nearest(vecs(spark, rows + bad + rows[:5] + [(900, [1.0] * 64, 64)]))
    near = {}
    for r in got.orderBy("vec_id", "rank").collect():
        near.setdefault(r.vec_id, []).append(r.neighbour)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    assert set(near) == set(range(120))
    for i in range(120):
        assert near[i] == list(np.lexsort((np.arange(120), -s[i]))[:10])
    assert neighbours.nearest(vecs(spark, [])).count() == 0


def test_any_dimension_is_searched(spark):
    x = np.random.default_rng(5).standard_normal((40, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 5) for i, v in enumerate(x)] + [(100 + i, v[:3].tolist(), 3) for i, v in enumerate(x[:4])]
    got = neighbours.nearest(vecs(spark, rows)).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == {**{i: 10 for i in range(40)}, **{100 + i: 3 for i in range(4)}}
    assert {r.vec_id for r in neighbours.nearest(vecs(spark, rows), dims=(3,)).collect()} == {100, 101, 102, 103}


def _recall(x, found, rows):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u[rows] @ u.T, 12)
    s[np.arange(len(rows)), rows] = -9
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    return np.mean([len(found[i] & set(t)) / 10 for i, t in zip(rows, top)])


def _found(near):
    got = {}
    for r in near.collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    return got


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTITION", 1024)
    monkeypatch.setattr(neighbours, "WANTED", 300)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((200, 64))
    x = (centre[rng.integers(0, 200, 4000)] + 0.5 * rng.standard_normal((4000, 64))).astype(np.float32)
    got = _found(neighbours.nearest(vecs(spark, [(i, v.tolist(), 64) for i, v in enumerate(x)])))
    assert _recall(x, got, np.arange(4000)) >= 0.9


# Mean cosines of 0.99, 0.9999 and 0.99999 inside the cluster, which has most of the vectors.
@pytest.mark.parametrize("spread", [1e-1, 1e-2, 3e-3])
def test_tight_cluster_recall(spread):
    rng = np.random.default_rng(8)
    x = np.r_[rng.standard_normal(64) + spread * rng.standard_normal((6000, 64)), rng.standard_normal((2000, 64))].astype(np.float32)
    near = {}
    for group in range(neighbours.GROUPS):
        for a, b, c in zip(*neighbours.search_partition(np.arange(8000), x.astype(float), group, 10)):
            near.setdefault(a, {})[b] = (-c, b)
    found = {a: {b for _, b in sorted(v.values())[:10]} for a, v in near.items()}
    assert _recall(x, found, rng.choice(6000, 300, replace=False)) >= 0.9


@pytest.mark.parametrize("spread", [1e-1, 1e-2, 3e-3])
def test_tight_cluster_over_partitions(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "PARTITION", 1024)
    rng = np.random.default_rng(10)
    x = np.r_[rng.standard_normal(64) + spread * rng.standard_normal((3000, 64)), rng.standard_normal((500, 64))].astype(np.float32)
    got = _found(neighbours.nearest(vecs(spark, [(i, v.tolist(), 64) for i, v in enumerate(x)])))
    assert _recall(x, got, np.arange(3000)) >= 0.9
    shared = neighbours.Shared(64, 0, 2, x / np.linalg.norm(x, axis=1, keepdims=True))
    sizes = np.bincount(shared.leaves(x / np.linalg.norm(x, axis=1, keepdims=True), 1)[:, 0])
    assert sizes.max() <= 1.1 * sizes.min()


def test_one_direction_goes_by_id():
    x = np.outer(1 + np.arange(2000) / 7, np.random.default_rng(9).standard_normal(32))
    a, b, _ = neighbours.search_partition(np.arange(2000), x, 0, 10)
    assert set(range(10)) <= set(b[a == 1999]) and set(range(10)) <= set(b[a == 1000])


def test_strings_are_as_long_as_clusters_are_tight():
    rng = np.random.default_rng(2)
    x = np.r_[rng.standard_normal((500, 16)), 5 + 1e-3 * rng.standard_normal((3000, 16))]
    code, flat = neighbours.strings(x, np.ones(len(x), bool), 16, 0, 1)
    assert np.bincount(np.unique(code, return_inverse=True)[1]).max() <= neighbours.LEAF and not flat.any()
    bits = neighbours.shared_bits(np.sort(code))
    assert bits.max() > 8 and bits.min() == 0


def test_prefixes_ascend_together():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    f = neighbours.Forest(np.arange(3000), x, np.zeros(3000, bool), 0, 10)
    few, many = f.prefixes(100), f.prefixes(1000)
    assert (many <= few).all() and len(set(few)) > 1
    at, bits, before, _ = f.trees[0]
    assert before[-1] == 3000 and len(bits) == 2999


# -- 6 -------------------------------------------------------------------------------------------

MSG = "id string, conversation_id string, role string, content string, created_at string, metadata string, received_at timestamp, rows long, depth string, chunk string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, datetime(2025, 1, 1), 1, "x", "x") for r in rows], MSG)


@pytest.mark.parametrize("t,us", [("2025-01-06T04:10:40Z", 1736136640000000), ("1736123387000", 1736123387000000), ("1736239152", 1736239152000000), ("2025-01-07T09:44:28+02:00", 1736235868000000), (" 2025-01-06 00:39:36.5 ", 1736123976500000), ("0000-00-00 00:00:00", None), ("yesterday", None), ("", None), (None, None), ("2025-02-30 00:00:00", None)])
def test_instants(spark, t, us):
    assert spark.createDataFrame([(t,)], "t string").select(conversations.instant_of(F.col("t")).alias("x")).first().x == us


@pytest.mark.parametrize("ranges", [None, 7])
def test_conversations(spark, request, ranges):
    if ranges:
        # Seven ranges over these rows cut the conversations.
        for key, value in (("spark.sql.shuffle.partitions", str(ranges)), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
            old = spark.conf.get(key)
            request.addfinalizer(lambda key=key, old=old: spark.conf.set(key, old))
            spark.conf.set(key, value)
    s = lambda i: f"2025-01-01T00:00:{i:02d}Z"
    rows = [
        ("a0", "A", "System", "be nice", s(0), None), ("a1", "A", "human", "hi", s(1), "{}"), ("a2", "A", " AI", "hello", s(2), "broken"), ("a3", "A", "user", "more", s(3), None), ("a3b", "A", "user", " more\n", s(4), None), ("a4", "A", "bot", "yes", s(5), None), ("a4", "A", "bot", "yes", s(5), None),
        ("b1", "B", "user", "q", s(7), None), ("b2", "B", "assistant", "r", s(7), '{"reply_to": "b1"}'), ("b0", "B", "user", "q2", s(7), '{"reply_to": "b2"}'), ("b3", "B", "assistant", "r2", s(7), '{"reply_to": "b0"}'),
        ("c1", "C", "user", "q", s(1), None), ("d1", "D", "assistant", "q", s(1), None), ("d2", "D", "user", "q", s(2), None), ("d3", "D", "assistant", "q", s(3), None),
        ("e1", "E", "user", "q", "yesterday", None), ("e2", "E", "assistant", "q", s(3), None), ("f1", "F", "user", "​", s(1), None), ("f2", "F", "assistant", "q", s(3), None), ("g1", "G", "?", "q", s(1), None), ("g2", "G", "assistant", "q", s(3), None),
        ("h1", "unknown", "user", "q", s(1), None), ("h2", "unknown", "assistant", "q", s(3), None), (None, None, None, None, None, None), ("i1", "I", "user", "q", s(1), None), ("i2", "I", "assistant", "q", s(2), None), ("i3", "I", "user", "again", s(3), None),
    ]
    known = spark.createDataFrame([(c, "t") for c in "ABCDEFGI"] + [("A", "t")], "id string, title string")
    got = {}
    for r in conversations.rebuild_conversations(messages(spark, rows), known).orderBy("conversation_id", "turn_no").collect():
        got.setdefault(r.conversation_id, []).append((r.turn_no, r.message_id, r.role))
    assert got == {"A": [(0, "a0", "system"), (1, "a1", "user"), (2, "a2", "assistant"), (3, "a3", "user"), (4, "a4", "assistant")], "B": [(0, "b1", "user"), (1, "b2", "assistant"), (2, "b0", "user"), (3, "b3", "assistant")]}
    assert conversations.rebuild_conversations(messages(spark, []), known).count() == 0


def test_sessions_split_at_gaps(spark):
    s = lambda h, i: f"2025-01-01T{h:02d}:00:{i:02d}Z"
    rows = [("1", "A", "user", "q", s(0, 1), None), ("2", "A", "assistant", "r", s(0, 2), None), ("3", "A", "user", "q", s(9, 1), None), ("4", "A", "assistant", "r", s(9, 2), None), ("5", "A", "assistant", "alone", s(20, 0), None)]
    got = conversations.rebuild_conversations(messages(spark, rows), None, 3_600_000_000).orderBy("at").collect()
    assert [(r.session_no, r.turn_no, r.message_id) for r in got] == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (1, 1, "4")]
    whole = conversations.rebuild_conversations(messages(spark, rows[:4]), None, 3_600_000_000, join_sessions=True).orderBy("at").collect()
    assert [(r.session_no, r.turn_no, r.message_id) for r in whole] == [(0, 0, "1"), (0, 1, "2"), (1, 2, "3"), (1, 3, "4")]
    assert conversations.rebuild_conversations(messages(spark, [])).count() == 0


def test_planted_sessions_are_found(spark):
    rng = random.Random(11)
    rows, want, n = [], set(), 0
    for c in range(60):
        at, no = 1_735_700_000.0 + c, 0
        for session in range(rng.randint(1, 4)):
            at += rng.uniform(7_000, 90_000)
            broken = rng.random() < 0.2
            first = n
            for _ in range(rng.randint(1, 5)):
                for role in ("user",) if broken else ("user", "assistant"):
                    # One role in nine is unreadable; it answers what stands before.
                    shown = "?" if rng.random() < 0.11 and role == "assistant" else role
                    rows.append((f"m{n:05d}", f"c{c}", shown, f"text {n}", str(int(at * 1000)), None))
                    n, at = n + 1, at + rng.uniform(1, 90)
            if not broken:
                want.add((f"c{c}", session, n - first))
    rng.shuffle(rows)
    got = conversations.rebuild_conversations(messages(spark, rows), infer_roles=True).groupBy("conversation_id", "session_no").count().collect()
    got = {(r.conversation_id, r.session_no, r["count"]) for r in got}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_gaps_of_one_mode_part_nothing():
    import math

    normal = {b: int(10_000 * math.exp(-((b - 50) ** 2) / 30)) for b in range(30, 80)}
    assert conversations.second_mode(normal) is None and conversations.second_mode({}) is None and conversations.second_mode({3: 9}) is None
    both = {b: normal.get(b, 0) + int(600 * math.exp(-((b - 95) ** 2) / 20)) for b in range(30, 110)}
    assert 62 < conversations.second_mode(both) < 90


def test_replies_in_a_circle(spark):
    t = "2025-01-01T00:00:00Z"
    rows = [("a", "A", "user", "q", t, '{"reply_to": "b"}'), ("b", "A", "assistant", "r", t, '{"reply_to": "a"}'), ("c", "A", "assistant", "s", t, '{"reply_to": "b"}')]
    assert conversations.rebuild_conversations(messages(spark, rows)).count() == 0
    got = conversations.rebuild_conversations(messages(spark, rows[:2])).orderBy("turn_no").collect()
    assert [r.message_id for r in got] == ["a", "b"]


def test_long_chain_of_replies_in_an_instant(spark):
    t, n = "2025-01-01T00:00:00Z", 300
    name = lambda i: f"{(i * 7919) % 10007:05d}"
    rows = [(name(i), "A", "user" if i % 2 == 0 else "assistant", f"t{i}", t, f'{{"reply_to": "{name(i - 1)}"}}' if i else None) for i in range(n)]
    got = conversations.rebuild_conversations(messages(spark, rows)).orderBy("turn_no").collect()
    assert [r.message_id for r in got] == [name(i) for i in range(n)]


# -- 8 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    hist = {}
    for _ in range(500):
        n = rng.choice([rng.randint(1, 2048), rng.randint(1, 60)])
        hist[n] = hist.get(n, 0) + 1
    plan = packing.shortest_pack_first(hist, 2048)
    used = {}
    for lengths, count in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] = used.get(x, 0) + count
    assert used == hist
    least = -(-sum(k * v for k, v in hist.items()) // 2048)
    assert sum(c for _, c in plan) <= least * 1.05 + 1


def test_packing_rows(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 2048, 2049, 0, None, 1, 1, 100, 100, 2047])] + [(1, 2048)], "doc_id long, tokens int").withColumn("container", F.lit("x")).withColumn("length", F.lit(9))
    got = packing.pack(rows).collect()
    assert sum(r.tokens for r in got) == 5000 + 2048 * 2 + 2049 + 202 + 2047
    held = {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.tokens
    assert max(held.values()) <= 2048 and len(held) == -(-sum(held.values()) // 2048)
    assert sorted((r.part_no, r.first_token, r.tokens) for r in got if r.doc_id == 0) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert packing.pack(rows.limit(0)).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    enc = packing.encoder()
    rows = [(1, "hello world <|endoftext|>", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, "é" * 5000, "en", "s")]
    got = {r.doc_id: r.tokens for r in packing.token_lengths(docs(spark, rows)).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in rows}


# -- 9 -------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = {}
    for r in b.collect():
        w = shingles.words_of(r.text)
        for i in range(len(w) - 11):
            runs.setdefault(tuple(w[i : i + 12]), set()).add(r.item_id)
    want = set()
    item = b.first()
    w = item.text.split()
    extra = [(9001, "x " + " ".join(w[:12]) + " y"), (9002, " ".join(w[:11])), (9003, "**" + "**\n> _".join(item.text.upper().split()) + "_"), (9004, None), (9005, ""), (9003, "**" + item.text)]
    both = d.union(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in both.collect():
        ws = shingles.words_of(r.text or "")
        for i in range(len(ws) - 11):
            want |= {(r.doc_id, k) for k in runs.get(tuple(ws[i : i + 12]), ())}
    got = leakage.leaked_items(both.withColumn("ids", F.lit("x")), b.union(spark.createDataFrame([(999, None, "en"), (998, "", "en"), (997, "too short", "en")], b.schema)))
    assert {(r.doc_id, r.item_id) for r in got.where("kind = 'exact'").collect()} == want
    assert leakage.leaked_items(both.limit(0), b).count() == 0 and leakage.leaked_items(both, b.limit(0)).count() == 0


def test_paraphrases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("lang = 'en'").orderBy("item_id").limit(20)
    item = b.first()
    # Function words left out or changed, in no run of twelve words the same.
    changed = ["a" if x == "the" else x for x in shingles.words_of(item.text) if x not in ("of", "is")]
    runs = {tuple(shingles.words_of(item.text)[i : i + 12]) for i in range(100)}
    assert not any(tuple(changed[i : i + 12]) in runs for i in range(len(changed) - 11))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(9001, " ".join(changed))], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.kind) for r in leakage.leaked_items(d, b, paraphrases=True).collect()}
    assert (9001, item.item_id, "paraphrase") in got


def test_paraphrase_after_stray_windows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("lang = 'en'").orderBy("item_id").limit(20)
    item = b.first()
    changed = ["a" if x == "the" else x for x in shingles.words_of(item.text) if x not in ("of", "is")]
    w, long = shingles.words_of(item.text), []
    for i in range(0, len(w) - 11, 11):  # eleven words and another, far apart
        long += [*w[i : i + 11], "a" if w[i + 11] == "the" else "the", *["zzz"] * 1000]
    long += changed
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(9001, " ".join(long))], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.kind) for r in leakage.leaked_items(d, b, paraphrases=True).collect()}
    assert (9001, item.item_id, "paraphrase") in got
    assert leakage._clusters(np.array([5, 900, 7, 15, 16, 26]), 10).tolist() == [5, 16, 900]


def test_items_come_in_blocks(spark, sf_dir, monkeypatch):
    b = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(30)
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(b.select((F.col("item_id") + 90_000).alias("doc_id"), "text"))
    found = lambda: {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, b).where("kind = 'exact'").collect()}
    whole = found()
    monkeypatch.setattr(leakage, "ITEM_WORDS", 700)
    assert len(list(leakage._item_blocks(b))) > 1 and found() == whole and len(whole) >= 30


# -- 10 ------------------------------------------------------------------------------------------

GARBLES = {
    "utf-8>cp1252": lambda t: "".join(map(_as_1252, t.encode())),
    "utf-8>latin-1": lambda t: t.encode().decode("latin-1"),
    "utf-8>cp437": lambda t: t.encode().decode("cp437"),
    "utf-8>mac": lambda t: t.encode().decode("mac_roman"),
    "cp1252>mac": lambda t: t.encode("cp1252").decode("mac_roman"),
    "cp1252>cp850": lambda t: t.encode("cp1252").decode("cp850"),
    "twice": lambda t: GARBLES["utf-8>cp1252"](GARBLES["utf-8>cp1252"](t)),
}


def _as_1252(b):
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def test_garbles_round_trip(spark, sf_dir):
    clean = [r.text for r in table(spark, sf_dir, "lang_samples").where("lang in ('de', 'fr', 'es', 'pt')").orderBy("sample_id").collect()]
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(400):
        t = " ".join(rng.sample(clean, 6))
        kind = list(GARBLES)[i % len(GARBLES)] if i % 8 == 0 else None
        if kind:
            half = len(t) // 2
            g = GARBLES[kind](t) if i % 16 else t[:half] + GARBLES[kind](t[half:])
            if g != t:
                want[i] = hashlib.md5(t.encode()).hexdigest()
                t = g
        rows.append((i, t, None, rng.choice(["a", "b", None])))
    lost = "D�r Ordner"
    rows += [(900, lost, "de", "a"), (901, None, "de", "a"), (902, "", "de", "a"), (903, "Ã/Õ 16 √29 © Ø 79 mm", "de", "a"), (904, "plain", "de", None), (906, "la qualità\xa0– e poi", "it", "a"), (905, clean[0] * 3000, "de", "a")]
    got = {r.doc_id: r.restored_md5 for r in encodings.garbled_documents(docs(spark, rows)).collect()}
    assert got.pop(900) == "" and not {901, 902, 903, 904, 905, 906} & set(got)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert encodings.garbled_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("written,read", [("cp1252", "koi8_r"), ("cp1252", "iso8859_5"), ("utf-8", "cp1250"), ("utf-8", "cp1251")])
def test_unknown_pages_are_learned(spark, sf_dir, written, read):
    """Pages outside the list: one source of four is garbled by them in a third of its texts."""
    assert read not in encodings.PAGES
    clean = [r.text for r in table(spark, sf_dir, "lang_samples").where("lang in ('de', 'fr', 'es', 'pt')").orderBy("sample_id").collect()]
    rng, rows, want = random.Random(6), [], {}
    for i in range(500):
        t = " ".join(rng.sample(clean, 6))
        source = "abcd"[i % 4]
        if source == "d" and i % 12 == 3:
            try:
                g = "".join(bytes([b]).decode(read) for b in t.encode(written))
            except UnicodeError:
                continue
            want[i], t = hashlib.md5(t.encode()).hexdigest(), g
        rows.append((i, t, None, source))
    got = {r.doc_id: r.restored_md5 for r in encodings.garbled_documents(docs(spark, rows)).collect()}
    assert len(want) >= 20 and len(set(got) & set(want)) >= 0.95 * len(want) and len(set(got) - set(want)) <= 0.05 * len(want)
    assert sum(got.get(i) == want[i] for i in want) >= 0.9 * len(want)


def test_a_mapping_of_its_own_is_learned():
    """A substitution that no pair of pages makes."""
    rng = np.random.default_rng(1)
    words = "für über schön größe früh spät müde höhe wäre würde öffnen ähnlich straße fuß".split()
    counts = {}
    for w in rng.choice(words, 4000):
        for i, c in enumerate(w):
            if ord(c) > 127:
                k = (w[i - 1] if i else " ", c, w[i + 1] if i + 1 < len(w) else " ")
                counts[k] = counts.get(k, 0) + 1
    model = encodings.Bigrams(counts)
    swap = str.maketrans("äöüß", "ΑΒΓΔ")
    rows = [(a, c.translate(swap), b, n / 20) for (a, c, b), n in counts.items()]
    found = encodings.symbol_mapping(rows, model)
    assert {c: x for c, (x, _) in found.items()} == {"Α": "ä", "Β": "ö", "Γ": "ü", "Δ": "ß"}
    (channel,) = encodings.channels_of(found)
    assert encodings.undo("ΓΒΑ", channel) == "üöä"


def test_layers_and_long_runs(spark, sf_dir):
    clean = [r.text for r in table(spark, sf_dir, "lang_samples").where("lang in ('de', 'fr')").orderBy("sample_id").collect()]
    rng = random.Random(7)
    rows = [(i, " ".join(rng.sample(clean, 6)), None, "a") for i in range(200)]
    # Five swaps in one text, each of which is undone by itself.
    kinds = ["utf-8>cp1252", "utf-8>cp437", "utf-8>mac", "cp1252>mac", "cp1252>cp850"]
    parts = [" ".join(t for t in rng.sample(clean, 8)) for _ in kinds]
    want = " ".join(parts)
    deep = " ".join(GARBLES[k](t) for k, t in zip(kinds, parts))
    rows += [(900 + i, GARBLES[kinds[i % 5]](r[1]), None, "a") for i, r in enumerate(rows[:20])]
    # A run of more than LONG_RUN characters beside garbled words; the run itself is text of another script.
    other = "п" * 40 + "р" * 31
    rows += [(950, deep, None, "a"), (951, other + " " + GARBLES["utf-8>cp1252"](want), None, "a")]
    got = {r.doc_id: r.restored for r in encodings.garbled_documents(docs(spark, rows)).collect()}
    assert got[950] == want and got[951] == other + " " + want


# -- queries -------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    from conftest import canonical

    assert canonical(queries.queries()[name](spark, sf_dir).toPandas()) == canonical(duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "papyrine"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts and "papyrine.llm" in f.read_text()]
