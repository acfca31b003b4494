from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import types as T

from veilspark.operators import logparse as L

SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("level", T.StringType()), T.StructField("line_no", T.IntegerType()),
])
AT = datetime(2025, 3, 4)

TEXTS = {
    1: "junk before\n2025-03-04T01:02:03.456789Z WARN  service=alpha it broke\n  at x.y(Z.java:3)\n2025-03-04 was a good day\n2025-03-04T03:02:04+02:00 Err svc=beta again",
    2: "<130>1 2025-03-04T01:02:03Z host prog 77 ID1 - hi\n<15>Mar  4 01:02:03 host-1 cron[12]: ERROR in the text",
    3: "Mar  4 01:02:03 host-1 cron[12]: hello",
    4: "[Tue Mar 04 01:02:03.999999 2025] [core:crit] [pid 7] boom\r\n\r\nW0304 01:02:03.456789   12 a_b.cc:33] glog\r\n",
    5: '{"ts": 1741050123456, "level": 60, "logger": "a.B", "msg": "x"}\n{\n  "severity": "info",\n  "time": "2025-03-04T01:02:03Z",\n  "service": "s",\n  "message": "m"\n}\n  tail',
    6: "Level: Verbose\nDate: 04-Mar-2025 01:02:03\nSource: Src\nEvent ID: 3\nDescription: d\nValueError: bad\nLevel: Critical\nDate: 04-Mar-2025 01:02:04\nSource: Src\nEvent ID: 3\nDescription: e",
    7: 'Warning,04-Mar-2025 01:02:03,Src,11,None,"text, more"\nError\t2025-03-04 01:02:04\tOther\t12\tNone\ttext',
    8: '2025-03-04 01:02:03,582 - a.b - WARNING - text\n2025-03-04 01:02:03,582 [pool-1] DEBUG c.D - text\ntime="2025-03-04T01:02:03Z" level=err component=q msg="z"',
    9: "2025-03-04T01:02:03.100Z\t16757845-aaa9-4809-a5ca-ddac3ad6c935\tINFO\tgate: ok\n[ERROR]\t2025-03-04T01:02:03.100Z\t16757845-aaa9-4809-a5ca-ddac3ad6c935\t[auth.s] no",
    10: "", 11: " \n", 12: None, 13: "no entry\nat all 12:00:00",
}
BASE = 1741050123000
EXPECT = {
    (1, 2, 3, BASE + 456, "WARN", "alpha"), (1, 5, 1, BASE + 1000, "ERROR", "beta"),
    (2, 1, 1, BASE, "FATAL", "prog"), (2, 2, 1, BASE, "DEBUG", "cron"),
    (3, 1, 1, BASE, "", "cron"),
    (4, 1, 2, BASE + 999, "FATAL", "core"), (4, 3, 1, BASE + 456, "WARN", "a_b.cc"),
    (5, 1, 1, BASE + 456, "FATAL", "a.B"), (5, 2, 7, BASE, "INFO", "s"),
    (6, 1, 6, BASE, "DEBUG", "Src"), (6, 7, 5, BASE + 1000, "FATAL", "Src"),
    (7, 1, 1, BASE, "WARN", "Src"), (7, 2, 1, BASE + 1000, "ERROR", "Other"),
    (8, 1, 1, BASE + 582, "WARN", "a.b"), (8, 2, 1, BASE + 582, "DEBUG", "c.D"), (8, 3, 1, BASE, "ERROR", "q"),
    (9, 1, 1, BASE + 100, "INFO", "gate"), (9, 2, 1, BASE + 100, "ERROR", "auth.s"),
}


def frame(spark, texts):
    rows = [(k, v, " Application_log " if k % 2 else "AWS_CLOUDWATCH", AT, "clash", 1) for k, v in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_layout(spark):
    df = frame(spark, TEXTS)
    got = L.parse_logs(df.unionByName(df.where("record_id = 1")), message=False).collect()
    assert len(got) == len(EXPECT)
    assert {tuple(r) for r in got} == EXPECT


def test_messages_hold_the_lines_that_belong(spark):
    got = {(r.record_id, r.line_no): r.message for r in L.parse_logs(frame(spark, TEXTS)).collect()}
    assert got[1, 2] == "it broke\n  at x.y(Z.java:3)\n2025-03-04 was a good day"
    assert got[5, 2] == "m\n  tail"
    assert got[6, 1] == "d\nValueError: bad"


def test_empty_table_other_types_and_null_year(spark):
    assert L.parse_logs(frame(spark, TEXTS).where("false")).count() == 0
    other = spark.createDataFrame([(1, TEXTS[3], "FILE", AT, "", 1), (2, TEXTS[3], None, AT, "", 1), (3, TEXTS[3], "aws_cloudwatch", None, "", 1)], SCHEMA)
    got = L.parse_logs(other, message=False).collect()
    assert [tuple(r)[:2] for r in got] == [(3, 1)]


def test_long_record_and_ties(spark):
    long = "\n".join(f"2025-03-04T01:02:03Z INFO service=s{i % 3} text {i}" for i in range(20_000))
    got = L.parse_logs(frame(spark, {1: long, 2: long}), message=False)
    assert got.count() == 40_000
    assert got.where("n_lines = 1").count() == 40_000


SERVICES, WORDS = ("billing", "auth.token", "gateway", "order-sync", "mailer"), ("INFO", "WARN", "ERROR", "DEBUG")
MESSAGES = ("started ok", "user 17 logged in", "cache miss for key a7", "retry 3 of 5 after timeout", "done", "connection to 10.0.0.7 lost", "flush took 12 ms", "job queued", "disk almost full")
#: Layouts that no rule names: time, level, service and message in any order and frame.
LAYOUTS = (
    "[{s}] {l} {t} {m}", "{t} | {l} | {s} | {m}", "{l}:{s}:{t} {m}", "{t} {s} {l} {m}", "{t} {l} {s} {m}", "{s}: {t} {l} {m}", "{t} [{l}] {s}: {m}", "{t} {l} [{s}] {m}", "{l} {t} {s} - {m}", "{t}; {l}; {s}; {m}", "<{s}> {t} {l} {m}",
    "{t} ({s}) {l}: {m}", "{l} [{t}] {s}: {m}", "{t} [{s}] [{l}] {m}", "{t} - {l} - {s} - {m}", "[{t}][{l}][{s}] {m}", "{l} {s} {t}: {m}", "{t}\t{l}\t{s}\t{m}", "{s} {l} [{t}] {m}", "{s} | {t} | {l} | {m}",
)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_unknown_layouts_are_mined(spark, layout):
    lines = [layout.format(t=f"2026-03-{d + 1:02d} 10:00:0{d}", l=WORDS[d % 4], s=SERVICES[d % 5], m=MESSAGES[d]) for d in range(9)]
    text = "\n".join([lines[0], "  a line that belongs", *lines[1:]])
    got = sorted(L.parse_logs(frame(spark, {1: text})).collect(), key=lambda r: r.line_no)
    assert [(r.level, r.component) for r in got] == [(WORDS[d % 4], SERVICES[d % 5]) for d in range(9)]
    if ";" not in layout:
        assert [r.message for r in got] == [MESSAGES[0] + "\n  a line that belongs", *MESSAGES[1:]]
    assert [r.n_lines for r in got] == [2] + [1] * 8


def test_entries_without_a_component_and_prose_with_times(spark):
    text = "\n".join(f"2026-03-0{d + 1} 10:00:00 {WORDS[d % 4]} {MESSAGES[d]}" for d in range(9))
    prose = "\n".join(f"They met at 2026-03-0{d + 1} 10:00:00 in the {MESSAGES[d]}" for d in range(9))
    got = L.parse_logs(frame(spark, {1: text, 2: prose})).collect()
    assert {r.record_id for r in got} == {1} and len(got) == 9 and {r.component for r in got} == {""}
    assert {r.message for r in got} == set(MESSAGES)


def test_keys_get_roles_by_their_values(spark):
    import json

    rows = [json.dumps({"at": f"2026-03-0{d % 9 + 1}T10:00:00Z", "sev": WORDS[d % 4].lower(), "unit": SERVICES[d % 5], "note": f"{MESSAGES[d % 9]} {d}"}) for d in range(60)]
    got = L.parse_logs(frame(spark, {1: "\n".join(rows)})).collect()
    assert len(got) == 60 and {(r.level, r.component) for r in got} == {(WORDS[d % 4], SERVICES[d % 5]) for d in range(60)}


def test_merging_in_parts_gives_the_same_entries(spark, monkeypatch):
    df = frame(spark, {k: v for k, v in TEXTS.items()}).repartition(7)
    monkeypatch.setattr(L, "MERGE_PARTS", (1,))
    one = {tuple(r) for r in L.parse_logs(df, message=False).collect()}
    monkeypatch.setattr(L, "MERGE_PARTS", (3, 2, 1))
    assert {tuple(r) for r in L.parse_logs(df, message=False).collect()} == one == EXPECT


def test_many_key_sets_do_not_meet_in_one_group():
    m = L.Miner()
    m.record("\n".join('{"ts": "2026-03-01T10:00:00Z", "k%d": "v"}' % d for d in range(3000)))
    rows = m.rows()
    assert len({(kind, bucket) for kind, bucket, *_ in rows}) > 3000


def test_template_merging():
    a, b = L.tokenise("2025-03-04T01:02:03Z INFO service=alpha one"), L.tokenise("2025-03-04T01:02:04Z WARN svc=beta other thing")
    t = L.merge(a, b)
    assert t[0] == ("T", "iso") and ("k", None) in t and t[-1][0] == "*"
    assert L.merge(a, L.tokenise("x y z")) is None
    assert L.lcs("abcd", "axcd", lambda x, y: x == y) == [(0, 0), (2, 2), (3, 3)]


@pytest.mark.parametrize(("text", "ms"), [("1741050123", BASE), ("1741050123.4567", BASE + 456), (1741050123456, BASE + 456), ("2025-03-04T01:02:03-0100", BASE + 3_600_000), ("2025-13-04T01:02:03Z", None), (True, None), (None, None), ("7", None)])
def test_times(text, ms):
    assert L.value_time(text, 2025) == ms
