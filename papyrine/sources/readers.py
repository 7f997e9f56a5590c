"""Readers: folders, texts, tables, line records, benchmark corpora."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans.ordered import dense_index

EXTENSIONS = (".txt", ".docx", ".pdf", ".md", ".csv", ".xlsx")
#: Decoders of binary formats by extension; others are plugged in with ``register_decoder``.
_DECODERS: dict[str, Callable[[bytes], list[tuple[int, str, str]]]] = {}


def register_decoder(extension: str, decode: Callable[[bytes], list[tuple[int, str, str]]]) -> None:
    """``decode`` turns a file's bytes into rows (page, kind, text)."""
    _DECODERS[extension.lower()] = decode


def _xml_text(data: bytes) -> str:
    import html

    return html.unescape(re.sub(r"<[^>]+>", "", data.decode("utf-8", "replace")))


def decode_docx(data: bytes) -> list[tuple[int, str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = z.read("word/document.xml")
    parts = re.findall(rb"<w:p[ >].*?</w:p>|<w:p/>", body, re.S)
    return [(0, "text", "\n".join(_xml_text(p) for p in parts))]


def decode_xlsx(data: bytes) -> list[tuple[int, str, str]]:
    """One row per sheet, its cells as comma-separated lines."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_xml_text(x) for x in re.findall(rb"<si>.*?</si>", z.read("xl/sharedStrings.xml"), re.S)]
        names = re.findall(r'<sheet [^>]*name="([^"]*)"', z.read("xl/workbook.xml").decode())
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for i, name in enumerate(sheets):
            lines = []
            for row in re.findall(rb"<row[ >].*?</row>", z.read(name), re.S):
                cells = []
                for attrs, inner in re.findall(rb"<c([^>]*)>(.*?)</c>", row, re.S):
                    v = re.search(rb"<v>(.*?)</v>", inner, re.S)
                    text = _xml_text(v[1]) if v else _xml_text(inner)
                    cells.append(shared[int(text)] if b't="s"' in attrs and text.isdigit() else text)
                lines.append(",".join(cells))
            title = names[i] if i < len(names) else f"Sheet{i + 1}"
            out.append((i, "sheet", f"Sheet: {title}\n" + "\n".join(lines)))
    return out


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_PDF_SHOWN = re.compile(rb"\((?P<text>(?:\\.|[^\\()])*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<move>T\*|Td|TD|Tm|'|\")(?![A-Za-z])|(?P<end>ET)(?![A-Za-z])|(?P<back>-?\d+(?:\.\d+)?)", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    def one(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _PDF_ESCAPES.get(x, b"" if x in (b"\n", b"\r") else x)

    data = re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def decode_pdf(data: bytes) -> list[tuple[int, str, str]]:
    """The text layer of a PDF, one row for each content stream that shows text, in the order of the file.

    Streams may be deflated; simple fonts are read as Western text. Scanned pages have no text layer and
    encrypted files cannot be read: both are for a plugged-in decoder, and say so as an error.
    """
    import zlib

    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    out = []
    for m in _PDF_STREAM.finditer(data):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        lines, words = [], []
        for block in re.findall(rb"(?<![A-Za-z])BT(?![A-Za-z]).*?(?<![A-Za-z])ET(?![A-Za-z])", body, re.S):
            for t in _PDF_SHOWN.finditer(block):
                if t["text"] is not None:
                    words.append(_pdf_string(t["text"]))
                elif t["hex"] is not None:
                    h = re.sub(rb"\s", b"", t["hex"])
                    words.append(_pdf_string(bytes.fromhex((h + b"0" * (len(h) % 2)).decode())))
                elif t["back"] is not None:
                    # A wide step back inside a shown array parts words.
                    if words and float(t["back"]) < -200 and not words[-1].endswith(" "):
                        words.append(" ")
                elif words:
                    lines.append("".join(words))
                    words = []
            if words:
                lines.append("".join(words))
                words = []
        if any(x.strip() for x in lines):
            out.append((len(out) + 1, "text", "\n".join(lines)))
    if not out:
        raise ValueError("no text layer")
    return out


register_decoder(".pdf", decode_pdf)
register_decoder(".docx", decode_docx)
register_decoder(".xlsx", decode_xlsx)


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, extension, length, modified): files below a folder with an allowed extension; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return f.select("path", ext.alias("extension"), "length", F.col("modificationTime").alias("modified")).where(F.col("extension").isin(*extensions))


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".txt", ".md", ".docx", ".xlsx", ".pdf")) -> DataFrame:
    """(path, file_hash, page, kind, text, error): files decoded by extension; a file that cannot be is a row with its error."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./]+)$", 1)))
    rows = f.select("path", F.sha2("content", 256).alias("file_hash"), ext.alias("ext"), "content").where(F.col("ext").isin(*extensions))
    decoders = dict(_DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, h, e, c in zip(pdf["path"], pdf["file_hash"], pdf["ext"], pdf["content"]):
                try:
                    parts = decoders[e](bytes(c)) if e in decoders else [(0, "text", bytes(c).decode("utf-8", "replace"))]
                    out += [(p, h, page, kind, text, None) for page, kind, text in parts]
                except Exception as x:  # a broken file must not end the run
                    out.append((p, h, None, None, None, f"{type(x).__name__}: {x}"[:200]))
            yield pd.DataFrame(out, columns=["path", "file_hash", "page", "kind", "text", "error"]).astype({"page": "Int64"})

    return rows.mapInPandas(run, "path string, file_hash string, page int, kind string, text string, error string")


def csv_rows(spark: SparkSession, path: str, text_column: str | None = None) -> DataFrame:
    """(row, text) of the text column: the named one, else text, content, or the first; blank rows are skipped."""
    t = spark.read.csv(path, header=True)
    low = {c.lower(): c for c in t.columns}
    name = text_column or low.get("text") or low.get("content") or t.columns[0]
    return t.select(F.monotonically_increasing_id().alias("row"), F.col(name).alias("text")).where(F.trim("text") != "")


def csv_blocks(spark: SparkSession, path: str, size: int = 25) -> DataFrame:
    from papyrine.operators.chunking import row_blocks

    t = spark.read.csv(path, header=True)
    return row_blocks(dense_index(t, "_i"), "_i", t.columns, size)


def chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, metadata) of line records; lines that cannot be read are dropped."""
    j = spark.read.option("mode", "DROPMALFORMED").json(path)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in j.columns], F.lit(None).cast("string"))
    return j.select(pick("chunk_id", "doc_id", "id").alias("doc_id"), pick("text", "document", "content").alias("text"), F.to_json(F.struct(*[c for c in j.columns if c not in ("text", "document", "content")])).alias("metadata"))


def chunks_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks of all producers under one schema; missing columns are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def benchmark_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    j = spark.read.schema("_id string, title string, text string").json(path)
    out = j.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text")).where("text != ''")
    return out if limit is None else out.limit(limit)


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of a tab-separated file with a header."""
    t = spark.read.csv(path, sep="\t", header=True)
    a, b, c = t.columns[:3]
    return t.select(F.col(a).alias("qid"), F.col(b).alias("doc_id"), F.col(c).cast("int").alias("rel"))


def questions_to_corpus(rows: DataFrame, question: str = "question", documents: str = "documents") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements) of rows of a question and its documents; ids are hashes of the text."""
    q = rows.select(F.md5(F.col(question)).alias("qid"), F.col(question).alias("text"), F.col(documents).alias("_d"))
    each = q.select("qid", F.explode("_d").alias("text")).where("text is not null").withColumn("doc_id", F.md5("text"))
    return each.select("doc_id", "text").dropDuplicates(["doc_id"]), q.select("qid", "text").dropDuplicates(["qid"]), each.select("qid", "doc_id", F.lit(1).alias("rel")).distinct()


def smart_sample(documents: DataFrame, qrels: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """All relevant documents, and the first others by key up to ``size``."""
    rel = qrels.select(key).distinct()
    kept = documents.join(rel, key, "left_semi")
    room = max(0, size - kept.count())
    return kept.unionByName(documents.join(rel, key, "left_anti").orderBy(key).limit(room))
