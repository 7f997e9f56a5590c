import zipfile

from pyspark.sql import functions as F

from papyrine.sources import readers, writers
from papyrine.streaming import streams


def _docx(path, paragraphs):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")


def _xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="One" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>A &amp; B</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData>')


def _pdf(pages):
    import zlib

    out = b"%PDF-1.4\n"
    for i, (text, deflate) in enumerate(pages):
        body = zlib.compress(text) if deflate else text
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n" % (i + 4, len(body), b" /Filter /FlateDecode" if deflate else b"") + body + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


def test_pdf_text_layer(spark, tmp_path):
    one = rb"BT /F1 12 Tf 72 700 Td (Caf\351 \(old\)) Tj 0 -14 Td [(Wo) -20 (rd) -300 (two)] TJ T* <4869> Tj ET"
    (tmp_path / "a.pdf").write_bytes(_pdf([(one, True), (b"BT 1 0 0 1 72 700 Tm (Page two) Tj ET", False)]))
    (tmp_path / "b.pdf").write_bytes(_pdf([(b"q 10 0 0 10 0 0 cm /Im1 Do Q", True)]))
    got = {(r.path.rsplit("/", 1)[1], r.page): r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf", 1].text == "Café (old)\nWord two\nHi" and got["a.pdf", 2].text == "Page two"
    assert "no text layer" in got["b.pdf", None].error


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_text("# T")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.exe").write_text("no")
    _docx(tmp_path / "e.docx", ["one", "two &amp; three"])
    _xlsx(tmp_path / "f.xlsx")
    assert readers.discover(spark, str(tmp_path)).count() == 5
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "héllo" and got["e.docx"].text == "one\ntwo & three" and got["c.docx"].error
    assert got["f.xlsx"].text == "Sheet: One\nname\nA & B,7"


def test_tables_and_lines(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,content\n" + "".join(f"{i},row {i}\n" for i in range(60)) + "61,  \n")
    assert readers.csv_rows(spark, str(p)).count() == 60
    blocks = readers.csv_blocks(spark, str(p)).orderBy("block").collect()
    assert [(b.row_start, b.row_end) for b in blocks] == [(0, 24), (25, 49), (50, 60)] and blocks[1].chunk.startswith("id,content\n25,row 25")
    j = tmp_path / "c.jsonl"
    j.write_text('{"id": "x", "text": "hello", "n": 1}\nnot json\n{"id": "y", "text": "there"}\n')
    assert {r.doc_id for r in readers.chunks_jsonl(spark, str(j)).where("text is not null").collect()} == {"x", "y"}
    q = tmp_path / "q.tsv"
    q.write_text("query-id\tcorpus-id\tscore\n1\td1\t1\n")
    assert readers.judgements(spark, str(q)).first() == ("1", "d1", 1)
    c = tmp_path / "b.jsonl"
    c.write_text('{"_id": "1", "title": "T", "text": "body"}\n{"_id": "2", "title": "", "text": ""}\n')
    assert [r.text for r in readers.benchmark_corpus(spark, str(c)).collect()] == ["T body"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, n int")
    out = str(tmp_path / "chunks")
    writers.append_new(rows, out)
    assert writers.append_new(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), out).count() == 1 or spark.read.parquet(out).count() == 3
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    writers.save_index(docs, str(tmp_path / "ix"), files=2)
    assert {r.term: r.df for r in writers.load_index(spark, str(tmp_path / "ix"))["df"].collect()} == {"one": 1, "two": 2, "three": 1}
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "id string, updated_at int, v int")
    old.write.parquet(str(tmp_path / "old"))
    writers.upsert(spark.createDataFrame([("a", 2, 20)], old.schema), str(tmp_path / "old"), str(tmp_path / "new"))
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {("a", 20), ("b", 10)}
    writers.write_manifest(spark, str(tmp_path / "m"), rows=2)
    assert spark.read.json(str(tmp_path / "m")).first().rows == "2"
    writers.export_audit(old, str(tmp_path / "audit"))
    assert spark.read.csv(str(tmp_path / "audit"), header=True).count() == 2
    writers.save_vectors(old, str(tmp_path / "v"), files=1)
    assert writers.vectors_by_id(spark, str(tmp_path / "v"), old.limit(1)).count() == 1


def test_tailing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"asctime": "2025-01-01 00:00:00,500", "levelname": "info", "name": "a", "message": "m"}\nbroken\n')
    s = streams.tail_logs(spark, str(tmp_path / "in"))
    got = streams.run_to_memory(s, "tailed", checkpoint=str(tmp_path / "cp")).collect()
    assert [(r.level, r.component, r.message) for r in got] == [("INFO", "a", "m")]


def test_stream_windows_and_cache(spark, tmp_path):
    rows = [("k", f"2025-01-01 00:0{i}:00") for i in range(0, 9, 2)] + [("j", "2025-01-01 00:00:00")]
    spark.createDataFrame(rows, "key string, at string").select("key", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    schema = "key string, at timestamp"
    w = streams.windowed_counts(streams.tail_parquet(spark, str(tmp_path / "ev"), schema), "at", "key")
    assert sum(r.n for r in streams.run_to_memory(w, "counted", "complete", str(tmp_path / "c1")).collect()) == 6
    c = streams.ttl_cache(streams.tail_parquet(spark, str(tmp_path / "ev"), schema), "key", "at", 300)
    got = sorted((r.key, r.at.minute, r.hit) for r in streams.run_to_memory(c, "cached", checkpoint=str(tmp_path / "c2")).collect())
    assert got == [("j", 0, False), ("k", 0, False), ("k", 2, True), ("k", 4, True), ("k", 6, False), ("k", 8, True)]
    d = streams.first_by_key(streams.tail_parquet(spark, str(tmp_path / "ev"), schema), "key", "at")
    assert streams.run_to_memory(d, "firsts", checkpoint=str(tmp_path / "c3")).count() == 2
