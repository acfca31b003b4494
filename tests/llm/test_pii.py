from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import pii

F = pii.Finder(["Anna", "Marco", "Zoë", "Ilse"], ["Norwick", "Denholm"])

CASES = [
    ("mail a.b+c@host.example now", "EMAIL", "a.b+c@host.example"), ("Write to jo-x [at] mail.test.", "EMAIL", "jo-x [at] mail.test"), ("x kofi.d(at)vault [dot] invalid, ok", "EMAIL", "kofi.d(at)vault [dot] invalid"),
    ("to: ＡＢ@ｈｏｓｔ．ｔｅｓｔ", "EMAIL", "ＡＢ@ｈｏｓｔ．ｔｅｓｔ"), ("еlіf@rіԁgе.test", "EMAIL", "еlіf@rіԁgе.test"),
    *((f"ring {p} at four", "PHONE", p) for p in ("(474) 555-0118", "532.555.0164", "345-555-0124 ext. 12", "+17705550159", "+1-621-555-0126", "+1 (905) 555-0195", "1 784 555 0128", "01 99 00 17 48", "01.99.00.41.61", "+33 1 99 00 46 88", "+49 30 23125 512", "0049 30 23125820", "030/23125-639", "07700 900714", "+44 (0)20 7946-0641", "020 7946 0231")),
    ("ask her (1 360 555 0194)", "PHONE", "1 360 555 0194"),
    ("ssn=110-09-9157", "NATIONAL_ID", "110-09-9157"), ("SSN: 333540755 given", "NATIONAL_ID", "333540755"), ("no. QQ 43 68 38 C, issued", "NATIONAL_ID", "QQ 43 68 38 C"), ("id 1 1 3 - 6 7 - 8 0 4 4, issued", "NATIONAL_ID", "1 1 3 - 6 7 - 8 0 4 4"), ("Identity no. 18257141V.", "NATIONAL_ID", "18257141V"),
    ("now at 183 Cinder Lane, Eastmere, KS 40287 since", "ADDRESS", "183 Cinder Lane, Eastmere, KS 40287"), ("label: Flat 8, 899 Cinder Road, Denholm OX8 5ZZ", "ADDRESS", "Flat 8, 899 Cinder Road, Denholm OX8 5ZZ"), ("Wohnhaft Mühlenweg 39, 54462 Tarnstadt, hier", "ADDRESS", "Mühlenweg 39, 54462 Tarnstadt"),
    ("moved to 79 rue des Tilleuls, 86536 Saint-Osterin.", "ADDRESS", "79 rue des Tilleuls, 86536 Saint-Osterin"), ("at 940 Granary Drive, Apt 18, Cross", "ADDRESS", "940 Granary Drive, Apt 18, Cross"),
    ("Please call Qadir Vensko on Monday", "PERSON", "Qadir Vensko"), ("Mr Sarnmoor, Delphine signed", "PERSON", "Sarnmoor, Delphine"), ("Anna van der Lund moved", "PERSON", "Anna van der Lund"), ("x; MARCO SARN.", "PERSON", "MARCO SARN"), ("Kind regards,\nTeodor O'Lund\n", "PERSON", "Teodor O'Lund"), ("by Zoë T. Lund-Moor released", "PERSON", "Zoë T. Lund-Moor"), ("Ilse Jürgen Sarn moved", "PERSON", "Ilse Jürgen Sarn"),
]
NONE = ["postgresql://app:pw@host.example/db", "psql amqps://app@host.example/v", "deploy@build-07 shipped", "Follow @desk for", "card 4000 0063 0453 6899", "Part no. 651-10-056 and batch 921245584", "ticket 210-44-08524", "56-1240-1566-1", "203.0.113.250", "2024-02-04 10:11:12", "The Anna release train leaves", "Saint Anna Clinic confirmed", "release 2.16.55", "id 8d498441-aa9d-4420-a1ed-a4fd92b2464e", "contract with Quarry Foods SA covers", "May Harbour station", "", "   "]


@pytest.mark.parametrize(("text", "kind", "value"), CASES)
def test_found(text, kind, value):
    got = [(k, text[a:b]) for a, b, k in F.spans(text)]
    assert got == [(kind, value)]
    assert pii.scrub(text, F) == text.replace(value, f"[{kind}]")


@pytest.mark.parametrize("text", NONE)
def test_nothing(text):
    assert F.spans(text) == []


def test_paths():
    assert F.spans("185682150", "user.ssn") == [(0, 9, "NATIONAL_ID")] and F.spans("185682150", "order.no") == []
    assert F.spans("Qadir Vensko № 2", "audit.actor") == [(0, 12, "PERSON")] and F.spans("qadir vensko", "user.name") == [(0, 12, "PERSON")]
    assert F.spans("user.ssn: ssn\nuser.ssn: 185682150\nrow[0].name: Qadir Vensko\norder.title: Late Cable") == [(24, 33, "NATIONAL_ID"), (47, 59, "PERSON")]


@settings(max_examples=60)
@given(st.lists(st.sampled_from([*(c[0] for c in CASES), *NONE, "thе ｗｉｄｅ​ text"]), max_size=6))
def test_disjoint_and_the_rest_stays(parts):
    text = "\n".join(parts)
    got = F.spans(text)
    assert all(a < b <= len(text) for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    done, at = pii.scrub(text, F), 0
    for a, b, kind in got:
        assert done.startswith(text[at:a] + f"[{kind}]")
        done, at = done[a - at + len(kind) + 2 :], b
    assert done == text[at:]


def test_tables(spark):
    lexicon = spark.createDataFrame([("Anna", "given"), ("Norwick", "town"), (None, "given")], "token string, kind string")
    content = spark.createDataFrame([(1, "Anna Lund a@b.test", "c"), (1, "Anna Lund a@b.test", "c"), (2, None, "c"), (3, "", "c"), (4, "x " * 100_000 + "a@b.test", "c")], "record_id bigint, content string, path string")
    fields = spark.createDataFrame(
        [(1, "u.name", "Qadir Vensko", False), (2, "u.name", "Qadir Lund", False), (3, "u.name", "Moor, Qadir", False), (4, "u.name", "name", True), (5, "u.ssn", None, False), (6, "note", "x; Qadir Moor.", None), (6, "note", "x; Qadir Moor.", None)],
        "field_id bigint, path string, value string, is_key boolean",
    )
    names = pii.known_names(lexicon, fields)
    assert "Qadir" in names[0]
    got = sorted(tuple(r) for r in pii.found(content, fields, names).collect())
    assert got == [("content", 1, "EMAIL", 10), ("content", 1, "PERSON", 0), ("content", 4, "EMAIL", 200_000), ("field", 1, "PERSON", 0), ("field", 2, "PERSON", 0), ("field", 3, "PERSON", 0), ("field", 6, "PERSON", 3)]
    assert pii.found(content.where("false"), fields.where("false"), pii.known_names(lexicon.where("false"), fields.where("false"))).count() == 0
    assert pii.scrubbed(content, "content", names).where("record_id = 2").first().scrubbed is None


@pytest.mark.parametrize("at", ["(ät)", "[arroba]", "{ arroba }", "< at >", "[@]", "(@)", "{@}", "[ Ät ]"])
def test_every_evasive_at_leads_to_its_address(at):
    text = f"write to jo-x {at} mail.test."
    assert [(text[a:b], kind) for a, b, kind in F.spans(text)] == [(text[9:-1], "EMAIL")]


def test_property_names_are_inspected(spark):
    rows = [(1, "jo@mail.test", "jo@mail.test", True), (2, "staff.Anna Lund", "Anna Lund", True), (3, "u.address", "12 other words 3", True)]
    fields = spark.createDataFrame(rows, "field_id bigint, path string, value string, is_key boolean")
    content = spark.createDataFrame([], "record_id bigint, content string")
    assert sorted(tuple(r) for r in pii.found(content, fields, (("Anna",), ())).collect()) == [("field", 1, "EMAIL", 0), ("field", 2, "PERSON", 0)]


def test_learned_names_have_support(spark, monkeypatch):
    rows = [(f"{name} Vetch{n}", "user.name", False) for name, times in (("Priya", 5), ("Tomas", 3), ("Once", 2)) for n in range(times)] + [(None, "name", False), ("Ada Lund", None, None), ("name", "name", True)]
    fields = spark.createDataFrame(rows, "value string, path string, is_key boolean")
    assert pii.learned(fields) == ("Priya", "Tomas")
    monkeypatch.setattr(pii, "SUPPORT", 0.45)
    assert pii.learned(fields) == ("Priya",) and pii.learned(fields.union(fields).union(fields)) == ("Priya",)
    assert pii.learned(fields.where("false")) == ()
