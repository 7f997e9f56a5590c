"""Problem 3: pieces of bounded length cut at natural boundaries, with overlap.

One bounded-quantifier expression takes the text apart: its alternatives stand in
the order of the strength of the boundary they end at, each takes as much as the
limit allows, and the last takes characters where there is no boundary at all.
Everything else is array arithmetic, so the rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, and anything else.
WHITE, SOLID = r"[\s\x85\p{Z}]", r"[^\s\x85\p{Z}]"
#: Boundaries by strength: name and what the last characters of a piece must match.
BOUNDARIES = (("paragraph", r"(?<=\n[ \t\r]{0,8}\n)"), ("sentence", rf"(?<=[.!?…]['\"”’»)\]]{{0,3}}{WHITE})"), ("line", r"(?<=\n)"), ("space", rf"(?<={WHITE})"))

#: Parts whose sizes are summed at a time.
RUN = 256


def split_pattern(limit: int, overlap: int) -> str:
    """Pattern whose successive matches are the new parts of the pieces.

    A part leaves room for the overlap; a run without white space that needs that
    room gets it, and is only broken when it is longer than the limit itself.
    """
    room, least = limit - overlap, (limit - overlap) // 2
    rest = rf".{{1,{room}}}\z"
    strong = [rf".{{{least},{room}}}{b}" for _, b in BOUNDARIES]
    weak = rf".{{1,{room}}}(?<={WHITE})"
    run = rf"{SOLID}{{{room},{limit}}}(?={WHITE}|\z)"
    # The end of a run of exactly the limit keeps its one following space outside.
    return "(?s)" + "|".join([rest, *strong, weak, run, rf"{SOLID}{{{limit}}}", rf".{{1,{room}}}"])


def split_pieces(documents: DataFrame, limit: int = 2000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no, first_char, piece, boundary, overlap) of every text longer than ``limit`` code points.

    ``boundary`` names what the piece ends at: paragraph, sentence, line, space, end,
    or char where a run without white space had to be broken. Null and short texts
    give no row; empty tables give none. A piece repeats at most ``overlap`` characters
    of the one before it, from the next word start where the cut would fall inside a
    word; repeated rows are each split, and other columns are ignored.
    """
    if not 0 <= overlap * 2 <= limit:
        raise ValueError("overlap must be at most half the limit")
    base = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.char_length("_text") > limit)
    parts = base.select("_key", F.regexp_extract_all("_text", F.lit(split_pattern(limit, overlap)), F.lit(0)).alias("_parts"))
    # A piece is made of its part and its neighbours in the array, so the text itself is not carried along and the work grows as its length.
    # Two parts in a row hold more than the overlap: with less, the first could have been longer.
    parts = parts.withColumn("_sizes", F.transform("_parts", lambda p: F.char_length(p))).withColumn("_sums", F.expr(f"transform(sequence(0, (size(_sizes) - 1) div {RUN}), b -> aggregate(slice(_sizes, b * {RUN} + 1, {RUN}), 0, (a, x) -> a + x))"))
    parts = parts.withColumn("_before", F.expr("transform(_sums, (x, b) -> aggregate(slice(_sums, 1, b), 0, (a, y) -> a + y))"))
    start = f"_before[i div {RUN}] + aggregate(slice(_sizes, (i div {RUN}) * {RUN} + 1, i % {RUN}), 0, (a, x) -> a + x)"
    tail = f"right(concat(coalesce(get(_parts, i - 3), ''), coalesce(get(_parts, i - 2), ''), coalesce(get(_parts, i - 1), '')), {overlap + 1})"
    each = parts.select("_key", F.explode(F.expr(f"transform(_parts, (p, i) -> struct(i as piece_no, p as _part, {start} as _start, {tail} as _tail, substring(get(_parts, i + 1), 1, 1) as _next))")).alias("_x")).select("_key", "_x.*")
    boundary = F.when(F.col("_next").isNull(), "end")
    for name, end in (("paragraph", r"\n[ \t\r]*\n\z"), ("sentence", rf"[.!?…]['\"”’»)\]]{{0,3}}{WHITE}\z"), ("line", r"\n\z"), ("space", rf"{WHITE}\z")):
        boundary = boundary.when(F.col("_part").rlike(end), name)
    # A run that needed the whole limit ends before white space.
    boundary = boundary.when(F.col("_next").rlike(f"^{WHITE}"), "space").otherwise("char")
    each = each.withColumn("boundary", boundary).withColumn("_back", F.least("_start", F.lit(overlap), F.lit(limit) - F.char_length("_part")))
    # One character more than the overlap shows whether the overlap begins inside a word.
    each = each.withColumn("_tail", F.expr("right(_tail, if(_start = _back, _back, _back + 1))"))
    whole = F.expr("right(_tail, _back)")
    trimmed = F.when(F.col("_back") == 0, "").when(F.col("_tail").rlike(f"^{WHITE}") | (F.col("_start") == F.col("_back")), whole)
    trimmed = trimmed.when(F.expr("substring(_tail, 2)").rlike(WHITE + SOLID), F.regexp_replace(F.col("_tail"), f"^{SOLID}+{WHITE}+", "")).otherwise(whole)
    out = each.withColumn("_overlap", trimmed)
    return out.select(
        F.col("_key").alias(key),
        "piece_no",
        (F.col("_start") - F.char_length("_overlap")).alias("first_char"),
        F.concat("_overlap", "_part").alias("piece"),
        "boundary",
        F.char_length("_overlap").alias("overlap"),
    )


def oversized(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, forced): each document that was split; forced is 1 if a run without white space was broken."""
    return pieces.groupBy(key).agg(F.max((F.col("boundary") == "char").cast("int")).alias("forced"))
