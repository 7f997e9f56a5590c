from datetime import datetime

import pytest

from papyrine.operators import logs

F1, F2 = "logs/a/a-0-2025.log", "logs/p/p-0-2025-01-10.log"


@pytest.mark.parametrize(
    "line,level,component,ms,text",
    [
        ("2025-01-10 01:57:01,038 - INFO - api.probe - miss (3)", "INFO", "api.probe", 1736474221038, "miss (3)"),
        ("2025-01-10T06:26:33+02:00 | error | s.fuser | asked", "ERROR", "s.fuser", 1736483193000, "asked"),
        ("[2025-01-10T02:54:13.983Z] [warn] [r.fuser] retry", "WARNING", "r.fuser", 1736477653983, "retry"),
        ("Jan 10 02:32:04 node9 indexer.reader[802]: <fatal> started", "CRITICAL", "indexer.reader", 1736476324000, "started"),
        ('"10/Jan/2025:03:23:59 +0100","WARNING","g.merge","say ""hi"""', "WARNING", "g.merge", 1736475839000, 'say "hi"'),
        ("DEBUG    [w.reader] 2025/01/10 05:25:32 merged", "DEBUG", "w.reader", 1736486732000, "merged"),
        ("E0110 04:08:14.524000  8447 merge.cc:182] asked", "ERROR", "merge.cc", 1736482094524, "asked"),
        ("1736485541050 INF ocr.probe: written", "INFO", "ocr.probe", 1736485541050, "written"),
        ("1736487244.089 dbg ocr.fuser: tries", "DEBUG", "ocr.fuser", 1736487244089, "tries"),
        ('compose_2  | {"asctime": "2025-01-10 05:05:43,989", "levelname": "INFO", "name": "c.s", "message": "flag"}', "INFO", "c.s", 1736485543989, "flag"),
        ('msg="rate \\"x\\" fell" component=r.w ts=2025-01-10T02:20:35.822Z level=WARN pid=7', "WARNING", "r.w", 1736475635822, 'rate "x" fell'),
    ],
)
def test_layouts(line, level, component, ms, text):
    assert logs.parse_header(line, F1) == (level, component, ms, text)


def test_clock_takes_the_date_of_the_file():
    assert logs.parse_header("01:26:49.261 [pool-1] ERROR p.loader - stored", F2)[2] == 1736472409261
    assert logs.parse_header("01:26:49.261 [pool-1] ERROR p.loader - stored", F1) is None


@pytest.mark.parametrize("line", ["", "ERROR count: 7", "2025-01-10 02:35:09 is the last checkpoint kept", "[6, 5, 1] was returned", "  File \"/srv/x.py\", line 647, in merge", "    2025-01-10 01:57:01,038 - INFO - a.b - inside", "| 7529 |  8895 |", '{"a": 1}', "2025-13-10 01:57:01,038 - INFO - a.b - no such month"])
def test_no_headers(line):
    assert logs.parse_header(line, F1) is None


def test_routing_finds_only_layouts_with_their_anchor():
    assert [logs.LAYOUTS[i].name for i in logs.candidates("1736485541050 info ocr.probe: x")] == ["epoch"]
    assert logs.candidates("nothing here") == []


ROWS = "log_id long, message string, level string, component string, timestamp string, logfile string, line_no long, indexed_at timestamp, kind string, block string"
T = datetime(2025, 1, 10)


def _frame(spark, rows):
    return spark.createDataFrame([(i, *r, T, "clash", "clash") for i, r in enumerate(rows)], ROWS)


def test_entries(spark):
    head = "2025-01-10 01:57:01,038 - INFO - a.b - one"
    rows = [
        ("lost", "INFO", "log", None, F1, 1),
        (head, "INFO", "log", None, F1, 2),
        ("  more", "INFO", "log", None, F1, 3),
        (None, None, None, None, F1, 4),
        ("two", "DBG", "a.c", "2025-01-10T01:58:00.000+00:00", F1, 5),
        ("{", "INFO", "log", None, F1, 6),
        ('  "timestamp": "2025-01-10T02:00:00.000Z",', "INFO", "log", None, F1, 7),
        ('  "level": "CRIT",', "INFO", "log", None, F1, 8),
        ('  "component": "a.d",', "INFO", "log", None, F1, 9),
        ('  "message": "three"', "INFO", "log", None, F1, 10),
        ("}", "INFO", "log", None, F1, 11),
        (head, "INFO", "log", None, F1, 2),
        (head, "INFO", "log", None, None, 2),
        (head, "INFO", "log", None, F1, None),
    ]
    got = logs.log_entries(_frame(spark, rows)).orderBy("first_line").collect()
    assert [(r.first_line, r.last_line, r.level, r.component, r.event_ms) for r in got] == [
        (2, 4, "INFO", "a.b", 1736474221038), (5, 5, "DEBUG", "a.c", 1736474280000), (6, 11, "CRITICAL", "a.d", 1736474400000)]
    assert got[0].message == "one\n  more\n" and got[2].message.startswith("three")


def test_blocks_of_a_long_file_are_joined(spark, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK_LINES", 4)
    head = "2025-01-10 01:57:0%d,000 - INFO - a.b - x"
    lines = [head % 1, "c", "c", "c", "c", "c", head % 2, "{", '"timestamp": "no indent"', "c", "c", "{", '  "timestamp": "2025-01-10T02:00:00Z",', '  "level": "INFO"', "}"]
    got = logs.log_entries(_frame(spark, [(x, "INFO", "log", None, F1, i) for i, x in enumerate(lines)]), False).orderBy("first_line").collect()
    assert [(r.first_line, r.last_line) for r in got] == [(0, 5), (6, 10), (11, 14)]


def test_numbers_missing_at_a_block_edge(spark, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK_LINES", 10)
    lines = {1: "2025-01-10 01:57:01,000 - INFO - a.b - x", 9: "{", 34: '  "timestamp": "2025-01-10T02:00:00Z",', 37: '  "level": "INFO"', 52: "{", 71: "no field"}
    got = logs.log_entries(_frame(spark, [(x, "INFO", "log", None, F1, i) for i, x in lines.items()]), False).orderBy("first_line").collect()
    assert [(r.first_line, r.last_line) for r in got] == [(1, 1), (9, 71)]


def test_empty_table(spark):
    assert logs.log_entries(spark.createDataFrame([], ROWS)).count() == 0


def test_very_long_line(spark):
    rows = [("2025-01-10 01:57:01,038 - INFO - a.b - " + "x" * 300_000, "INFO", "log", None, F1, 1)]
    assert len(logs.log_entries(_frame(spark, rows)).first().message) == 300_000
