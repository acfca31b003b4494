from __future__ import annotations

import random

import numpy as np

from veilspark.llm import leakage as lk

ITEM = (
    "The night porter of Northgate Bank kept the keys to the granary in return for 2350 crowns and later sold the same kiln twice. "
    "A cooperative of 418 growers planted willows across the right of way without telling Lundmoor. Nobody may profit from a register which they themselves left blank at folio 771."
)
OTHER = ITEM.replace("Northgate", "Halcyon").replace("2350", "99").replace("418", "12").replace("Lundmoor", "Vetch").replace("771", "5")
STOCK = "There is no reason to depart from the settled case law of this court on the point."
ITEMS = [(1, ITEM), (2, f"{STOCK} The widow of Ardmoor moved the boundary stones by 77 paces and planted willows across the right of way without telling the parish of Holm."), (3, None), (4, ""), (5, "Too short")]
W = ITEM.split()


def spoil(text, seed=1):
    """Single words changed, added or dropped, about every ninth; names and figures stay."""
    rng, out = random.Random(seed), []
    for n, w in enumerate(text.split()):
        if n % 9 == 4 and w.islower():
            out += rng.choice([["sic"], [w, "then"], []])
        else:
            out.append(w)
    return " ".join(out)


DOCS = {
    1: (f"x. {ITEM} y", {1}),
    2: (f"x. {ITEM.upper()} y", {1}),
    3: (" ".join(W[10:36]), {1}),
    4: (" ".join(W[10:30]), set()),
    5: (f"Before. {OTHER} After.", set()),
    6: (STOCK * 3, set()),
    7: (spoil(ITEM), {1}),
    8: ("\n".join(" ".join(W[i : i + 6]) for i in range(0, len(W), 6)).replace("granary", "gran-\nary").replace("kiln", "ki​ln").replace("keys", "ｋｅｙｓ").replace("twice", "twісe"), {1}),
    9: (" ".join(W[:30]) + " something else was put in here by the clerk " + " ".join(W[30:]), {1}),
    10: (f"{ITEM} {ITEMS[1][1]}", {1, 2}),
    11: (" ".join(W[:14]) + "\nCT-42   R 474/2015   - 1 (2) -\n" + " ".join(W[14:30]), {1}),
    12: ("", set()),
    13: (None, set()),
    14: ("other words " * 100_000 + ITEM, {1}),
    15: (f"{' '.join(W[:12])} and other things {' '.join(W[12:24])} more and other things {' '.join(W[24:36])}", set()),
}


def test_documents(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, (t, _) in DOCS.items()] + [(1, DOCS[1][0], 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id bigint, passage string")
    got = [tuple(r) for r in lk.found(docs, items).collect()]
    assert len(got) == len(set(got))
    assert {k: {i for d, i in got if d == k} for k in DOCS} == {k: v for k, (_, v) in DOCS.items()}
    assert lk.found(docs, items.where("false")).count() == 0 and lk.found(docs.where("false"), items).count() == 0


def typer_of(*passages):
    """The vocabulary of some items, made in one place."""
    seen = [x for p in passages for x in zip(*lk.item_words(p))]
    named = {w for w, slot in seen if slot}
    words = {w for w, slot in seen if not slot and w not in named and not w[0].isdigit()}
    return lk.Typer(np.array(sorted(lk._hash(w) | 4 for w in words), dtype=np.uint64))


def brute(typer, item, text):
    """Longest span of the item by a plain table over all pairs of places."""
    look = lk.Aligner(typer, item)
    a, slot, b = look.words, look.slot, lk.words(text)
    best, table = 0, {}
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j]:
                first, met = i, 0
                for di, dj in ((1, 1), (1, 2), (2, 2), (2, 1)):
                    c = table.get((i - di, j - dj))
                    if c and c[1] > met and not (di == 2 and slot[i - 1]) and not (dj == 2 and b[j - 1].isdigit()):
                        first, met = c
                table[i, j] = (first, met + 1)
                span = i - first + 1
                if met + 1 >= span - lk.SPARE * max(1, span // lk.RUN):
                    best = max(best, span)
    return best


def test_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for n in range(80):
        a = rng.randrange(len(W) - 10)
        part = " ".join(W[a : a + rng.randrange(10, len(W))])
        texts.append("Some words before it. " + (spoil(part, n) if n % 2 else part) + " and some after. " + OTHER)
    typer = typer_of(ITEM)
    want = {n for n, t in enumerate(texts) if brute(typer, ITEM, t) >= lk.RUN}
    got = lk.found(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame([(1, ITEM)], "item_id bigint, passage string"))
    assert {r.doc_id for r in got.collect()} == want and 10 < len(want) < 80


def test_items_without_slots(spark):
    text = "a quiet word about nothing at all that goes on and on through every page of it until the reader is quite tired of what it said before"
    docs = spark.createDataFrame([(1, "so " + text + " end"), (2, text[:60]), (3, "nothing here")], "doc_id bigint, text string")
    got = lk.found(docs, spark.createDataFrame([(1, text), (2, ITEM)], "item_id bigint, passage string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1)]


def test_windows_agree_in_template_and_slots():
    base = "the lower court held that Emil T. Vetch of Holm paid 2,350 crowns for the mill"
    typer = typer_of(base + " crown kilometres km")
    of = lambda t: {(a, b) for a, b, *_ in zip(*typer.windows(lk.words(t)))}
    template = lambda t: {a for a, _ in of(t)}
    # other names and figures: the same template, other slots
    other = base.replace("Holm", "Lund").replace("2,350", "99")
    assert template(other) == template(base) and len(of(other) & of(base)) < len(of(base))
    # a run of names is known by its last word, figures by their digits, units by what they mean
    assert of(base.replace("Emil T. Vetch", "Vetch").replace("2,350", "2350")) == of(base)
    assert of(base.replace("crowns", "couronnes")) == of(base) and of(base.replace("crowns", "pounds")) != of(base)
    assert typer.windows([])[0].size == 0 and typer.windows(["a"])[0].size == 0


def test_results_do_not_depend_on_the_other_items(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, passage string")
    both = {tuple(r) for r in lk.found(docs, items.repartition(5)).collect()}
    assert both == {tuple(r) for r in lk.found(docs, items.coalesce(1)).collect()} == {(k, i) for k, (_, want) in DOCS.items() for i in want}


def test_both_forms_of_the_key_set(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, passage string")
    want = {tuple(r) for r in lk.found(docs, items).collect()}
    monkeypatch.setattr(lk, "MAX_KEYS", 3)
    monkeypatch.setattr(lk, "BITS", 256)
    assert {tuple(r) for r in lk.found(docs, items).collect()} == want
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 500, dtype=np.uint64)
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key bigint")
    assert lk.members(frame).bits is not None and lk.members(frame).among(keys).all()
    monkeypatch.setattr(lk, "BITS", 1 << 20)
    assert lk.members(frame).among(keys).all() and lk.members(frame).among(rng.integers(0, 2**64, 500, dtype=np.uint64)).sum() < 5


def test_tables_grow_with_the_words():
    typer = typer_of(ITEM)
    ws = [f"w{i}x" for i in range(20_000)] + ["granary", "7"]
    assert typer.codes(ws).size == typer.hashes(ws).size == 20_002 and typer.codes(ws)[-1] == lk.NUMBER and typer.codes(ws)[-2] > lk.UNIT
    typer.clear()
    assert typer.hashes(ws)[5] == lk._hash("w5x")


def test_windows_of_many_texts_are_those_of_each():
    typer = typer_of(ITEM)
    texts = [lk.words(t) for t in (ITEM, "", "Northgate", OTHER, "2350", "crowns and Vetch Lundmoor", "Vetch sold 418 crowns to Holm", ITEM[:60])]
    of, *all_ = typer.windows_of(texts)
    for k, ws in enumerate(texts):
        for whole, own in zip(all_, typer.windows(ws)):
            assert whole[of == k].tolist() == own.tolist()
