"""Log lines to log entries: layouts are routed by literal anchors, then verified by an expression.

An Aho-Corasick automaton over the anchors finds, in one pass over a line, which
layouts can apply at all; only their expressions run. A line that is no header
belongs to the entry before it in its file.
"""

from __future__ import annotations

import re
from calendar import timegm
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.plans.layout import cut

#: Line numbers of a file that one task orders at a time.
BLOCK_LINES = 50_000

# Level words and initials by meaning.
LEVELS = {
    "DEBUG": ["debug", "dbg", "dbug", "d", "trace", "trc", "verbose", "fine"],
    "INFO": ["info", "inf", "information", "informational", "i", "notice", "note"],
    "WARNING": ["warning", "warn", "wrn", "w"],
    "ERROR": ["error", "err", "e", "severe", "eror"],
    "CRITICAL": ["critical", "crit", "fatal", "ftl", "c", "f", "emerg", "emergency", "alert", "panic"],
}
_LEVEL = {w: k for k, ws in LEVELS.items() for w in ws}
_NAMES = r"(?P<level>" + "|".join(sorted((w for ws in LEVELS.values() for w in ws if len(w) > 1), key=lambda w: (-len(w), w))) + ")"
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


@dataclass(frozen=True)
class Layout:
    """``anchors``: literals of which one must stand in the line (empty: any line). ``pattern``: named groups time, level, component, message."""

    name: str
    anchors: tuple[str, ...]
    pattern: str


_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?: ?(?:Z|[+-]\d\d:?\d\d))?"
_COMPONENT = r"(?P<component>[\w$][\w$./-]*)"
LAYOUTS = (
    Layout("dashes", (" - ",), rf"(?P<time>{_ISO}) - {_NAMES} - {_COMPONENT} - (?P<message>.*)"),
    Layout("dashes_swapped", (" - ",), rf"(?P<time>{_ISO}) - {_COMPONENT} - {_NAMES} - (?P<message>.*)"),
    Layout("bars", (" | ",), rf"(?P<time>{_ISO}) \| {_NAMES}\s* \| {_COMPONENT}\s* \| (?P<message>.*)"),
    Layout("brackets", ("] [",), rf"\[(?P<time>{_ISO})\] \[{_NAMES}\s*\] \[{_COMPONENT}\] ?(?P<message>.*)"),
    Layout("syslog", ("]: <", ": <"), rf"(?P<time>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d) \S+ {_COMPONENT}(?:\[\d+\])?: <{_NAMES}> ?(?P<message>.*)"),
    Layout("quoted", ('","',), rf'"(?P<time>\d\d/[A-Z][a-z][a-z]/\d{{4}}:\d\d:\d\d:\d\d [+-]\d{{4}}|{_ISO})","{_NAMES}","{_COMPONENT}","(?P<message>.*)"'),
    Layout("clock", (" [",), rf"(?P<time>\d\d:\d\d:\d\d(?:[.,]\d{{1,9}})?) \[[^\]]*\] {_NAMES}\s+{_COMPONENT} - (?P<message>.*)"),
    Layout("level_first", (" [",), rf"{_NAMES}\s+\[{_COMPONENT}\] (?P<time>\d{{4}}[/-]\d\d[/-]\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d{{1,9}})?) (?P<message>.*)"),
    Layout("initial", ("] ",), rf"(?P<level>[DIWEFC])(?P<time>\d{{4}} \d\d:\d\d:\d\d(?:\.\d{{1,9}})?)\s+\d+ {_COMPONENT}(?::\d+)?\] (?P<message>.*)"),
    Layout("epoch", (": ",), rf"(?P<time>\d{{10}}(?:\.\d{{1,9}})?|\d{{13}}) {_NAMES} {_COMPONENT}: (?P<message>.*)"),
    Layout("json", ('{"',), r"(?:[\w.-]+\s+\| )?(?P<json>\{\".*\})\s*"),
    Layout("pairs", ("level=", "lvl=", "severity="), r"(?P<pairs>(?:[\w.]+=(?:\"(?:[^\"\\]|\\.)*\"|\S*)\s*){3,})"),
)
_COMPILED = tuple(re.compile(x.pattern, re.I if x.name not in ("initial", "syslog") else 0) for x in LAYOUTS)
_PAIR = re.compile(r"([\w.]+)=(\"(?:[^\"\\]|\\.)*\"|\S*)")
_JSON_FIELD = re.compile(r'\s+"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,?\s*$')

# Names that structured lines give to the four fields.
FIELDS = {
    "time": ["timestamp", "time", "ts", "asctime", "datetime", "date", "@timestamp", "t"],
    "level": ["level", "levelname", "lvl", "severity", "loglevel"],
    "component": ["component", "name", "logger", "module", "source", "comp"],
    "message": ["message", "msg", "text", "event"],
}
_FIELD = {n: k for k, ns in FIELDS.items() for n in ns}


def _automaton():
    by: dict[str, list[int]] = {}
    for i, x in enumerate(LAYOUTS):
        for a in x.anchors:
            by.setdefault(a.lower(), []).append(i)
    auto = ahocorasick.Automaton()
    for a, ids in by.items():
        auto.add_word(a, ids)
    auto.make_automaton()
    return auto


_AUTOMATON = _automaton()


def candidates(line: str) -> list[int]:
    """Layouts of which an anchor stands in the line, in the order of ``LAYOUTS``."""
    return sorted({i for _, ids in _AUTOMATON.iter(line.lower()) for i in ids})


def level_of(word: str | None) -> str | None:
    return _LEVEL.get((word or "").strip().lower())


_TIME = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))? ?(Z|[+-]\d\d:?\d\d)?$", re.I)
_CLF = re.compile(r"(\d\d)/([A-Za-z]{3})/(\d{4}):(\d\d):(\d\d):(\d\d)(?: ([+-]\d{4}))?$")
_SYSLOG = re.compile(r"([A-Za-z]{3}) ([ \d]\d) (\d\d):(\d\d):(\d\d)$")
_GLOG = re.compile(r"(\d\d)(\d\d) (\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?$")
_CLOCK = re.compile(r"(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?$")
_EPOCH = re.compile(r"(\d{10})(?:\.(\d{1,9}))?$|(\d{13})$")
_FILE_DATE = re.compile(r"(?<!\d)(\d{4})(?:-(\d\d)-(\d\d))?(?!\d)")


def _ms(y, mo, d, h, mi, s, frac=None, zone=None) -> int | None:
    try:
        datetime(int(y), int(mo), int(d), int(h), int(mi), min(int(s), 59))
    except ValueError:
        return None
    t = timegm((int(y), int(mo), int(d), int(h), int(mi), int(s))) * 1000
    t += int((frac or "0").ljust(3, "0")[:3])
    if zone and zone not in "Zz":
        z = zone.replace(":", "")
        t -= (int(z[1:3]) * 60 + int(z[3:5])) * 60_000 * (-1 if z[0] == "-" else 1)
    return t


def event_ms(text: str | None, logfile: str) -> int | None:
    """Milliseconds since 1970 UTC; a missing year or date comes from the file's name."""
    t = (text or "").strip()
    if m := _TIME.match(t):
        return _ms(*m.groups())
    if m := _EPOCH.match(t):
        return int(m[3]) if m[3] else int(m[1]) * 1000 + int((m[2] or "0").ljust(3, "0")[:3])
    if m := _CLF.match(t):
        mo = _MONTHS.get(m[2].lower())
        return _ms(m[3], mo, m[1], m[4], m[5], m[6], None, m[7]) if mo else None
    dates = list(_FILE_DATE.finditer(logfile.rsplit("/", 1)[-1]))
    if not dates:
        return None
    y, fm, fd = dates[-1].groups()
    if m := _SYSLOG.match(t):
        mo = _MONTHS.get(m[1].lower())
        return _ms(y, mo, m[2], m[3], m[4], m[5]) if mo else None
    if m := _GLOG.match(t):
        return _ms(y, m[1], m[2], m[3], m[4], m[5], m[6])
    if (m := _CLOCK.match(t)) and fm:
        return _ms(y, fm, fd, *m.groups())
    return None


def _structured(items, logfile: str):
    got: dict[str, str] = {}
    for k, v in items:
        f = _FIELD.get(k.lower())
        if f and f not in got and isinstance(v, str | int | float):
            got[f] = str(v)
    if "time" not in got or "level" not in got:
        return None
    level, ms = level_of(got["level"]), event_ms(got["time"], logfile)
    return None if level is None or ms is None else (level, got.get("component"), ms, got.get("message", ""))


def parse_header(line: str, logfile: str) -> tuple[str, str | None, int, str] | None:
    """(level, component, event_ms, message) of a line that starts an entry, else None."""
    for i in candidates(line):
        m = _COMPILED[i].fullmatch(line.rstrip("\r\n"))
        if not m:
            continue
        g = m.groupdict()
        if "json" in g:
            import json

            try:
                value = json.loads(g["json"])
            except ValueError:
                continue
            found = _structured(value.items(), logfile) if isinstance(value, dict) else None
        elif "pairs" in g:
            found = _structured(((k, v[1:-1].replace('\\"', '"') if v[:1] == '"' else v) for k, v in _PAIR.findall(g["pairs"])), logfile)
        else:
            level, ms = level_of(g["level"]), event_ms(g["time"], logfile)
            text = g["message"].replace('""', '"') if LAYOUTS[i].name == "quoted" else g["message"]
            found = None if level is None or ms is None else (level, g["component"], ms, text)
        if found:
            return found
    return None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kind, level, component, ms, text = [], [], [], [], []
        for message, lv, comp, stamp, logfile in zip(pdf["message"], pdf["level"], pdf["component"], pdf["timestamp"], pdf["logfile"]):
            k, got = 0, None
            message = message or ""
            if comp is not None and comp != "log":
                # The indexer understood this line: its columns are the fields.
                at = event_ms(stamp, logfile)
                k, got = 1, (level_of(lv), comp, at, message)
            elif found := parse_header(message, logfile):
                k, got = 1, found
            elif message.strip() == "{":
                k = 2
            elif m := _JSON_FIELD.match(message):
                f = _FIELD.get(m[1].lower())
                if f:
                    k = 3
                    value = m[2].replace('\\"', '"')
                    got = (level_of(value) if f == "level" else None, value if f == "component" else None, event_ms(value, logfile) if f == "time" else None, value if f == "message" else None)
            kind.append(k)
            got = got or (None, None, None, message)  # a record's other fields are columns, not message text
            level.append(got[0])
            component.append(got[1])
            ms.append(got[2])
            text.append(got[3])
        yield pd.DataFrame({"logfile": pdf["logfile"], "line_no": pdf["line_no"], "kind": kind, "f_level": level, "f_component": component, "f_ms": pd.array(ms, dtype="Int64"), "f_text": text})


def parse_lines(logs: DataFrame) -> DataFrame:
    """One row per physical line with its header fields, if it is a header.

    kind: 1 a header, 2 a lone opening brace, 3 a field of a JSON record over several
    lines, 0 anything else. Lines indexed twice count once, as first indexed; lines
    without file or number are left out.
    """
    once = (
        logs.where("logfile is not null and line_no is not null")
        .groupBy("logfile", "line_no")
        .agg(F.min_by(F.struct("message", "level", "component", F.col("timestamp").cast("string").alias("timestamp")), F.struct("indexed_at", "log_id")).alias("r"))
        .select("logfile", F.col("line_no").cast("long").alias("line_no"), "r.message", "r.level", "r.component", "r.timestamp")
    )
    return once.mapInPandas(_parse_batches, "logfile string, line_no long, kind int, f_level string, f_component string, f_ms long, f_text string")


def _with_entries(lines: DataFrame) -> DataFrame:
    """Adds ``first_line``: the number of the line that starts the entry a line belongs to (null before the first).

    Files are ordered in blocks of lines, not as wholes: a block is one window group,
    and what a block takes over from the ones before it is found on the table of
    block summaries, of one row per ``BLOCK_LINES`` lines.
    """
    placed = lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    inside = Window.partitionBy("logfile", "block").orderBy("line_no")
    # The line after a block's last is the first of the next block that has any, however many numbers are missing between.
    firsts = placed.groupBy("logfile", "block").agg(F.min_by("kind", "line_no").alias("first_kind"))
    nexts = firsts.select("logfile", "block", F.lead("first_kind").over(Window.partitionBy("logfile").orderBy("block")).alias("next_kind"))
    placed = placed.join(nexts, ["logfile", "block"])
    following = F.coalesce(F.lead("kind").over(inside), "next_kind")
    start = (F.col("kind") == 1) | ((F.col("kind") == 2) & (following == 3))
    marked = placed.withColumn("start", F.when(start, F.col("line_no"))).drop("next_kind")
    marked = marked.withColumn("first_line", F.last("start", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    summary = marked.groupBy("logfile", "block").agg(F.max("start").alias("last_start"))
    before = summary.withColumn("carried", F.max("last_start").over(Window.partitionBy("logfile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("logfile", "block", "carried")
    return marked.join(before, ["logfile", "block"], "left").withColumn("first_line", F.coalesce("first_line", "carried"))


def log_entries(logs: DataFrame, with_message: bool = True) -> DataFrame:
    """(logfile, first_line, last_line, level, component, event_ms[, message]) of all entries.

    A null message counts as an empty line. Lines before the first header of a file
    belong to no entry. An entry's message is its header's message and the lines that
    follow, joined by line ends; other columns are ignored.
    """
    parsed = parse_lines(logs)
    # Written once, as the lines meet the summaries of their own blocks below.
    lines = _with_entries(cut(parsed if with_message else parsed.drop("f_text"))).where("first_line is not null")
    # Fields stand in the header, or in the lines of a JSON record that a brace starts.
    head = F.col("line_no") == F.col("first_line")
    json_part = F.col("kind") == 3
    pick = lambda c: F.coalesce(F.max(F.when(head & (F.col("kind") == 1), F.col(c))), F.min_by(F.col(c), F.when(json_part & F.col(c).isNotNull(), F.col("line_no"))))
    aggs = [F.max("line_no").alias("last_line"), pick("f_level").alias("level"), pick("f_component").alias("component"), pick("f_ms").alias("event_ms")]
    if with_message:
        part = F.when(F.col("kind") != 2, F.struct("line_no", "f_text"))
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["f_text"]), "\n").alias("message"))
    return lines.groupBy("logfile", "first_line").agg(*aggs).select("logfile", "first_line", "last_line", "level", "component", "event_ms", *(["message"] if with_message else []))
