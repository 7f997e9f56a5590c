"""Structure detection and chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import ABBREVIATION, clean_text, raw_words, sentences
from papyrine.plans.layout import spread

# Headings of marked-down, legal and plain texts.
MARKDOWN = r"^(#{1,6})\s+(.+)$"
ARTICLE = r"^(Article|Art\.|ARTICLE)\s+(\d+[\w\.]*)[\s:.-]+(.+?)$"
SECTION = r"^(Section|Sec\.|SECTION|§)\s+(\d+[\w\.]*)[\s:.-]+(.+?)$"
PARAGRAPH = r"^(Paragraph|Para\.|§)\s+(\d+[\w\.]*)[\s:.-]*(.*)$"
PLAIN = [r"^([A-Z][A-Z\s]{3,})\s*$", r"^(\d+\.\s+[A-Z].+?)$", r"^([IVX]+\.\s+.+?)$"]

_MARKDOWN = re.compile(MARKDOWN, re.M)
_LEGAL = [(1, "article", re.compile(ARTICLE, re.M | re.I)), (2, "section", re.compile(SECTION, re.M | re.I)), (3, "paragraph", re.compile(PARAGRAPH, re.M | re.I))]
_PLAIN = [re.compile(p, re.M) for p in PLAIN]
_ABBREVIATION = re.compile(r"(^|[^\w])(" + ABBREVIATION.split("(", 3)[3].rsplit(")", 1)[0] + r")\.", re.I)


@dataclass(frozen=True)
class Node:
    level: int
    kind: str
    title: str
    start: int
    end: int
    numbering: str | None = None


def _spans(starts: list[int], own: list[int], length: int) -> list[int]:
    """For each start, the next of ``starts`` after it, or the text's length."""
    import bisect

    ordered = sorted(set(starts))
    return [ordered[i] if (i := bisect.bisect_right(ordered, s)) < len(ordered) else length for s in own]


def markdown_nodes(text: str) -> list[Node]:
    found = list(_MARKDOWN.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [Node(len(m[1]), f"h{len(m[1])}", m[2].strip(), m.start(), e) for m, e in zip(found, ends)]


def legal_nodes(text: str) -> list[Node]:
    """Articles end at the next article, sections at the next of both, paragraphs at the next of any."""
    found = [[m for m in p.finditer(text)] for _, _, p in _LEGAL]
    out, bounds = [], []
    for (level, kind, _), ms in zip(_LEGAL, found):
        bounds += [m.start() for m in ms]
        for m, end in zip(ms, _spans(bounds, [m.start() for m in ms], len(text))):
            title = (m[3] or "").strip() or (f"Paragraph {m[2]}" if kind == "paragraph" else "")
            out.append(Node(level, kind, title, m.start(), end, m[2]))
    return sorted(out, key=lambda n: n.start)


def plain_nodes(text: str) -> list[Node]:
    """Capitals, numbers and Roman numbers as levels 1 to 3.

    A node ends at the next of its level, so a level covers the text from its first heading on. It
    counts as far as the first heading of a higher level, and a node that reaches past that is left out.
    """
    kept: list[Node] = []
    border = len(text)
    for level, p in enumerate(_PLAIN, 1):
        found = list(p.finditer(text))
        ends = [m.start() for m in found[1:]] + [len(text)]
        kept += [Node(level, "section", m[1].strip(), m.start(), e) for m, e in zip(found, ends) if e <= border]
        border = min([border, *(m.start() for m in found[:1])])
    return sorted(kept, key=lambda n: n.start)


def text_format(t):
    """markdown, legal or text, as a column."""
    return F.when(t.startswith("#") | t.contains("\n#"), "markdown").when(t.contains("Article") | t.contains("Section") | t.contains("§"), "legal").otherwise("text")


def nodes_of(text: str, kind: str) -> list[Node]:
    return {"markdown": markdown_nodes, "legal": legal_nodes}.get(kind, plain_nodes)(text)


def paths(nodes: list[Node]) -> list[list[str]]:
    """Titles from the top to each node."""
    stack: list[Node] = []
    out = []
    for n in nodes:
        while stack and stack[-1].level >= n.level:
            stack.pop()
        stack.append(n)
        out.append([x.title for x in stack])
    return out


def sentences_of(text: str) -> list[str]:
    t = " ".join(text.split())
    t = _ABBREVIATION.sub("\\1\\2\x01", t)
    return [s for x in re.split(r"(?<=[.!?])\s+", t) if (s := x.replace("\x01", ".").strip())]


def pack(text: str, limit: int = 1000, least: int = 100, overlap: int = 1, token_limit: int | None = None) -> list[str]:
    """Paragraphs packed whole where they fit, by sentence where they do not.

    A chunk begins with the last ``overlap`` sentences of the one before. A last chunk of
    fewer than ``least`` characters is dropped unless it is the only one.
    """
    out: list[str] = []
    held: list[str] = []

    def fits(more: list[str]) -> bool:
        both = held + more
        return sum(map(len, both)) <= limit and (token_limit is None or sum(max(1, len(s.split())) for s in both) <= token_limit)

    def close() -> None:
        nonlocal held
        if held:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap else []

    for part in re.split(r"\n\s*\n", text):
        units = sentences_of(part)
        if not units:
            continue
        if not fits(units):
            close()
        if fits(units):
            held += units
            continue
        for s in units:
            if not fits([s]):
                close()
            held.append(s)
    rest = " ".join(held)
    if rest and (not out or len(rest) >= least):
        out.append(rest)
    return out or ([text] if text.strip() else [])


CHUNK_SCHEMA = "doc_id long, chunk_index int, text string, chunk_type string, level int, section_title string, numbering string, parent_context string, hierarchy array<string>, token_count int"


def hierarchical_chunks(documents: DataFrame, limit: int = 1000, least: int = 100, overlap: int = 1, include_preamble: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks along the detected structure with their place in it; texts without one are packed by size.

    Text before the first heading is left out unless asked for. Null and blank texts give no chunk.
    """
    rows = spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_format(F.col(text)).alias("kind")).where("text is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, kind in zip(pdf["doc_id"], pdf["text"], pdf["kind"]):
                nodes, n = nodes_of(t, kind), 0
                todo = [(t[x.start : x.end], x, p) for x, p in zip(nodes, paths(nodes))] if nodes else [(t, None, [])]
                if nodes and include_preamble and t[: nodes[0].start].strip():
                    todo.insert(0, (t[: nodes[0].start], None, []))
                for body, node, path in todo:
                    whole = body.strip()
                    parts = [whole] if node and len(body) <= limit and whole else pack(body, limit, least, overlap)
                    for c in parts:
                        out.append((d, n, c, node.kind if node else "text", node.level if node else 0, node.title if node else None, node.numbering if node else None, " → ".join(path), path, max(1, len(c.split()))))
                        n += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return rows.mapInPandas(run, CHUNK_SCHEMA)


def structure_nodes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node_no, level, kind, title, start, end, numbering)."""
    rows = spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_format(F.col(text)).alias("kind")).where("text is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, i, n.level, n.kind, n.title, n.start, n.end, n.numbering) for d, t, k in zip(pdf["doc_id"], pdf["text"], pdf["kind"]) for i, n in enumerate(nodes_of(t, k))]
            yield pd.DataFrame(out, columns=["doc_id", "node_no", "level", "kind", "title", "start", "end", "numbering"])

    return rows.mapInPandas(run, "doc_id long, node_no int, level int, kind string, title string, start int, end int, numbering string")


def markdown_headings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, level, title) of marked-down headings, in the JVM."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^#{1,6}[ \t]+\S"))
    return lines.select(key, "line_no", F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#{1,6}[ \t]+([^\r]+)", 1)).alias("title"))


def sentence_windows(documents: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_index, sentence, window_start, window_end, window): each sentence with those around it.

    The neighbours are sliced from the text's own array, so no window function and no shuffle is needed.
    """
    h = width // 2
    s = documents.select(key, sentences(F.col(text)).alias("_s"))
    e = s.select(key, "_s", F.posexplode("_s").alias("sentence_index", "sentence"))
    lo, hi = F.greatest(F.lit(0), F.col("sentence_index") - h), F.least(F.size("_s"), F.col("sentence_index") + h + 1)
    return e.select(key, "sentence_index", "sentence", lo.alias("window_start"), hi.alias("window_end"), F.array_join(F.slice("_s", lo + 1, hi - lo), " ").alias("window"))


def overlap_chunks(documents: DataFrame, size=None, overlap=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start, chunk): equal steps over the text; size and overlap follow its length unless given."""
    n = F.char_length(text)
    if size is not None and overlap is not None and overlap >= size:
        raise ValueError("overlap must be less than the size")
    size_ = F.lit(size) if size is not None else F.when(n < 1000, 200).when(n < 5000, 500).otherwise(1000)
    over_ = F.lit(overlap) if overlap is not None else F.when(n < 1000, 50).when(n < 5000, 100).otherwise(200)
    base = documents.where(n > 0).select(key, F.col(text).alias("_t"), size_.cast("int").alias("_n"), over_.cast("int").alias("_o"))
    e = base.select("*", F.posexplode(F.sequence(F.lit(0), F.char_length("_t") - 1, F.col("_n") - F.col("_o"))).alias("chunk_index", "start"))
    return e.select(key, "chunk_index", "start", F.substring(F.col("_t"), F.col("start") + 1, F.col("_n")).alias("chunk"))


def row_blocks(rows: DataFrame, order: str, columns: list[str], size: int = 25) -> DataFrame:
    """(block, row_start, row_end, chunk): tables as text blocks of ``size`` rows under a repeated header.

    ``order`` is a dense row number from 0, as a scan of a file gives it; blocks need no global sort.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    b = rows.select(F.floor(F.col(order) / size).cast("long").alias("block"), F.struct(F.col(order).alias("i"), line.alias("line")).alias("r"))
    g = b.groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return g.select("block", F.element_at("rs", 1)["i"].alias("row_start"), F.element_at("rs", -1)["i"].alias("row_end"), F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("rs", lambda x: x["line"]), "\n")).alias("chunk"))


def word_level_chunks(documents: DataFrame, sizes: tuple[int, ...] = (2048, 512, 128), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, chunk_index, start_word, end_word, chunk, chunk_id): words in packs of each size; offsets are word numbers."""
    w = documents.select(key, raw_words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("size")) for i, s in enumerate(sizes)]))
    e = w.select(key, "_w", levels.alias("l")).select(key, "_w", "l.level", "l.size").select("*", F.posexplode(F.sequence(F.lit(0), F.size("_w") - 1, F.col("size"))).alias("chunk_index", "start_word"))
    end = F.least(F.size("_w"), F.col("start_word") + F.col("size"))
    ident = F.substring(F.md5(F.concat_ws("_", F.col(key).cast("string"), F.col("level").cast("string"), F.col("chunk_index").cast("string"))), 1, 16)
    return e.select(key, "level", "chunk_index", "start_word", end.alias("end_word"), F.array_join(F.slice("_w", F.col("start_word") + 1, F.col("size")), " ").alias("chunk"), ident.alias("chunk_id"))


def parents(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, chunk_index, parent_index): the chunks of the level above whose words overlap a chunk's.

    The interval join is an equi-join: both sides carry the numbers of the 128-word bins they reach into.
    """
    c = chunks.select(key, "level", "chunk_index", "start_word", "end_word")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 128), F.floor((F.col(b) - 1) / 128)))
    child = c.where("level > 0").withColumn("bin", bins("start_word", "end_word")).withColumn("up", F.col("level") - 1)
    parent = c.select(key, F.col("level").alias("up"), F.col("chunk_index").alias("parent_index"), F.col("start_word").alias("ps"), F.col("end_word").alias("pe")).withColumn("bin", bins("ps", "pe"))
    return child.join(parent, [key, "up", "bin"]).where("start_word < pe and ps < end_word").select(key, "level", "chunk_index", "parent_index").distinct()


def chunker(name: str):
    """A chunking function by name."""
    known = {"hierarchical": hierarchical_chunks, "sentence_window": sentence_windows, "overlap": overlap_chunks, "multi_level": word_level_chunks, "structure": structure_nodes}
    if name not in known:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def first_seen(rows: DataFrame, text: str, order: list) -> DataFrame:
    """Rows without those whose cleaned text came before; a group of copies is reduced before it is shuffled."""
    kept = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.sha2(clean_text(F.col(text)), 256).alias("_h")).agg(kept.alias("_r")).select("_r.*")
