from __future__ import annotations

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilspark.llm import folding as fd
from veilspark.llm import lookalikes as lk


def test_tables():
    assert fd.plain("Ｆｕｌｌ wi​dth é") == "Full width é"
    assert fd.skeleton("Саfé") == fd.skeleton("Café") == "Café"
    assert fd.plain("²½ﬁ№") == "²½ﬁ№"


@pytest.mark.parametrize(("text", "known", "want"), [
    ("rеlease", {"release"}, "release"), ("rеlease", set(), "rеlease"), ("Отчёт по складу", {"Отчёт"}, "Отчёт по складу"),
    ("QQ 43 С", {"C"}, "QQ 43 C"), ("Oтчёт", {"Отчёт"}, "Отчёт"), ("", set(), ""), (None, set(), None), ("ｏｋ ｎｏ", set(), "ok no"),
])
def test_canonical(text, known, want):
    assert lk.canonical(text, known) == want


@given(st.text(alphabet="aоeеgɡ  ​ﬁ²ｘxт́", max_size=40))
def test_canonical_is_stable_and_looks_the_same(text):
    class All:
        def __contains__(self, _):
            return True

    done = lk.canonical(text, All())
    assert fd.skeleton(done) == fd.skeleton(text)
    assert lk.canonical(done, All()) == done


@given(st.text(alphabet="aоＡ  ​éx", max_size=30))
def test_fold_positions(text):
    folded, positions = fd.fold(text)
    if positions is None:
        assert len(folded) == len(text)
    else:
        assert len(positions) == len(folded) and positions == sorted(positions)
        assert all(fd.plain(text[p])[:1] in (c, fd.plain(text[p])) or c in fd.LOOKALIKE.values() or ord(c) > 127 for p, c in zip(positions, folded))


CONTENT = [
    (1, "w", "s", "the cable"), (2, "w", "s", "thе cable"), (3, "w", "s", "the cable"), (3, "w", "s", "the cable"), (4, "w", "s", "the cable"),
    (5, "w", "s", "The cable"), (6, "w", None, "thе cable"), (7, None, "s", "thе cable"), (8, "w", "s", None), (9, "w", "s", ""), (10, "v", "s", "thе cable"), (11, "w", "s", "th​ｅ cаblе"),
]
FIELDS = [(1, 1, "a b", "x"), (2, 1, "a b", "y"), (2, 1, "a b", "y"), (3, 1, "a²", "z"), (4, 1, "a2", "z"), (5, 2, "a b", "z"), (6, 2, None, "q"), (7, 3, "é", "q"), (8, 3, "é", "q")]


def brute(rows, key, group, text):
    return {
        tuple(sorted((a[key], b[key])))
        for a, b in itertools.combinations(set(rows), 2)
        if None not in (text(a), text(b)) and None not in (*group(a), *group(b)) and group(a) == group(b) and text(a) != text(b) and a[key] != b[key] and fd.skeleton(text(a)) == fd.skeleton(text(b))
    }


def test_pairs_against_brute_force(spark):
    content = spark.createDataFrame(CONTENT, "record_id bigint, workspace_id string, source_identifier string, content string")
    fields = spark.createDataFrame(FIELDS, "field_id bigint, record_id bigint, value string, form string")
    got = [tuple(r) for r in lk.look_alike_pairs(content, fields).collect()]
    want = {("content", *p) for p in brute(CONTENT, 0, lambda r: r[1:3], lambda r: r[3])} | {("field", *p) for p in brute(FIELDS, 0, lambda r: (r[1],), lambda r: r[2])}
    assert len(got) == len(set(got)) and set(got) == want


def test_sliced_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lk, "MAX_BROADCAST", 1)
    df = spark.createDataFrame([("the cable",), ("thе cablе",), ("thе саble",), (None,)], "text string")
    known = lk.vocabulary(df)
    assert {r[0] for r in known.collect()} == {"the", "cable"}
    rows = df.selectExpr("'x' as src", "monotonically_increasing_id() as key", "text")
    assert [r.canonical for r in lk.consistent(rows).collect()] == ["the cable"] * 2


def test_repairs_do_not_see_each_other(spark, monkeypatch):
    """All repairs of a text are told from the text as it stands, whichever way the vocabulary is looked up."""
    texts = ["thе саble С", "the cable", "Отчёт Oтчёт с", "С", "plain С x", "aсe оf basе", "ace of base"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").selectExpr("'x' as src", "key", "text")
    want = {i: lk.canonical(t, {r[0] for r in lk.vocabulary(rows.select("text")).collect()}) for i, t in enumerate(texts) if not t.isascii()}
    for most in (500_000, 0):
        monkeypatch.setattr(lk, "MAX_BROADCAST", most)
        assert {r.key: r.canonical for r in lk.consistent(rows).collect()} == want


def test_classes(spark):
    content = spark.createDataFrame(CONTENT, "record_id bigint, workspace_id string, source_identifier string, content string")
    fields = spark.createDataFrame(FIELDS, "field_id bigint, record_id bigint, value string, form string")
    got = lk.look_alike_classes(content, fields).collect()
    of = {(r.src, r.key): (r.class_id, r.n_texts, r.n_rows) for r in got}
    assert len(got) == len(of) and {k for k in of if k[0] == "content"} == {("content", i) for i in (1, 2, 3, 4, 11)}
    assert len({v for k, v in of.items() if k[0] == "content"}) == 1 and of["content", 1][1:] == (4, 5)
    pairs = {tuple(r) for r in lk.look_alike_pairs(content, fields).collect()}
    assert all(of[src, a][0] == of[src, b][0] for src, a, b in pairs) and {(s, k) for s, *ks in pairs for k in ks} == set(of)


def test_empty(spark):
    content = spark.createDataFrame([], "record_id bigint, workspace_id string, source_identifier string, content string")
    fields = spark.createDataFrame([], "field_id bigint, record_id bigint, value string")
    assert lk.look_alike_pairs(content, fields).count() == 0


def test_vocabulary_does_not_depend_on_the_switch(spark, monkeypatch):
    df = spark.createDataFrame([("two cm²",), ("two сm",), ("plain cable x½",), ("thе cаblе",), (None,), ("",)], "text string")
    below = {r[0] for r in lk.vocabulary(df).collect()}
    monkeypatch.setattr(lk, "MAX_BROADCAST", 0)
    assert {r[0] for r in lk.vocabulary(df).collect()} == below == {"cable"}


def test_texts_without_a_group_belong_to_the_corpus(spark):
    content = spark.createDataFrame([(1, "w", "s", "rеlease"), (2, "w", "s", "release "), (3, None, "s", "the release"), (4, "w", "s", "release")], "record_id bigint, workspace_id string, source_identifier string, content string")
    fields = spark.createDataFrame([], "field_id bigint, record_id bigint, value string")
    assert {tuple(r) for r in lk.look_alike_pairs(content, fields).collect()} == {("content", 1, 4)}
    assert {tuple(r) for r in lk.look_alike_pairs(content.where("record_id in (1, 3)"), fields).collect()} == set()
    got = {r.key: r.canonical for r in lk.consistent(lk.grouped(content.where("record_id in (1, 3)"), fields).select("src", "key", "text")).collect()}
    assert got == {1: "release"}
