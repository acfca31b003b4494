"""Evaluation passages inside a corpus, by template canonicalisation.

Texts become word sequences without case, accents, punctuation, look-alikes, layout and line-end
hyphens. Over them lie *template* sequences: numbers, names (every word that the evaluation items never
write in lower case, and runs of them as one) and the units behind numbers are typed placeholders. A
*window* is :data:`WINDOW` template tokens; it has the hash of its template and the hash of what stands in
its slots: figures by their digits, names by the last word of their run, units by what they mean.

1. The template words of all items are one vocabulary, counted over all items.
2. The items' windows are a table of (template, slots, item, place); those without a slot are in it only
   where an item has no slot for so long that others could miss a case.
3. One scan over the documents. Every document's windows are looked up in the keys of that table (an
   array, or beyond :data:`MAX_KEYS` a bit set that passes some others too); documents with a hit are
   written once, as word sequences, with their hits.
4. The hits are joined with the items' windows on both hashes, in a shuffle. A window whose template
   agrees and whose slots do not is a re-parameterised copy and joins nothing.
5. Only pairs of document and item that met are aligned, word by word, around where they met: chains of
   the item's words in sequence may step over a single word changed, added or dropped, but never over a
   name or figure that is not the item's own. A chain that spans :data:`RUN` words of the item, or all of a
   shorter one, is a case.

Defined results: NULL and empty texts and passages have no case; repeated rows give a case once; a
passage of fewer than RUN words must occur whole, and one of fewer than WINDOW template tokens never
counts. Extra columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.folding import fold
from veilspark.session import cut

WINDOW = 5
RUN = 26
#: Template words that every task takes with it (8 bytes each); the vocabulary of a language has far fewer.
MAX_VOCABULARY = 20_000_000
#: Window keys sent to the tasks as they are (8 bytes each); of more, a bit set of :data:`BITS` bits at most is sent.
MAX_KEYS = 8_000_000
BITS = 1 << 30
#: Words of texts that are hashed together.
AT_ONCE = 100_000
#: Words of a chain that may be missing among RUN of the item's words: single words changed or dropped.
SPARE = 5
#: Diagonals on either side of a met window that a chain of RUN words may reach.
DRIFT = 12

_WORDS = re.compile(r"\d+|[a-z0-9]+")
#: The marks between the thousands of a figure.
_THOUSANDS = re.compile(r"[.,](?<=\d[.,])(?=\d{3}(?!\d))")
_CASED = re.compile(r"\d+(?:[.,]\d{3})*(?![\d])|[A-Za-z0-9]+")
_HYPHEN = re.compile(r"-(?<=[A-Za-z]-)[ \t]*\r?\n[ \t]*(?=[a-z])")
#: Page headers and footers inside a scanned text.
_PAGE = re.compile(r"(?im)^.{0,60}?(?:\bpage \d{1,4} of \d{1,4}|[|/–—-] ?\d{1,4}/\d{1,4}|- ?\d{1,4} \(\d{1,4}\) ?-|\[page break\])[ \t]*\r?(?:\n|\Z)")
#: What every such line holds; most texts have none and are not walked line by line.
_PAGE_MARK = re.compile(r"(?i)page \d{1,4} of|[|/–—-] ?\d{1,4}/\d|- ?\d{1,4} \(\d|\[page break\]")
NUMBER, NAME, UNIT = 1, 2, 3
#: Units behind a number, each with its spellings (fixed values): one placeholder, compared by what they mean.
UNITS = {
    "percent": ("percent", "pct", "prozent", "pourcent", "ciento"), "metre": ("m", "metre", "metres", "meter", "meters", "mètres", "metros"), "kilometre": ("km", "kilometre", "kilometres", "kilometer", "kilometers"),
    "kilogram": ("kg", "kilogram", "kilograms", "kilogramm", "kilogrammes", "kilos"), "tonne": ("t", "tonne", "tonnes", "ton", "tons", "tonnen"), "litre": ("l", "litre", "litres", "liter", "liters"), "hectare": ("ha", "hectare", "hectares", "hektar"),
    "euro": ("eur", "euro", "euros"), "dollar": ("usd", "dollar", "dollars"), "pound": ("gbp", "pound", "pounds"), "franc": ("chf", "franc", "francs", "franken"), "crown": ("crown", "crowns", "kronen", "couronnes", "coronas"),
    "day": ("day", "days", "tag", "tage", "tagen", "jour", "jours", "día", "días", "dias", "dia"), "week": ("week", "weeks", "woche", "wochen", "semaine", "semaines", "semana", "semanas"), "month": ("month", "months", "monat", "monate", "monaten", "mois", "mes", "meses"),
    "year": ("year", "years", "jahr", "jahre", "jahren", "an", "ans", "année", "années", "año", "años", "anos", "ano"), "hour": ("h", "hour", "hours", "stunde", "stunden", "heure", "heures", "hora", "horas"),
}


#: What the letters of Latin, Greek and Cyrillic decompose to.
_ACCENTS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    """ASCII letters, digits and marks without page headers; the case stays."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", fold(text)[0])
        text = text if text.isascii() else _ACCENTS.sub("", text)
    if _PAGE_MARK.search(text):
        text = _PAGE.sub("", text)
    return _HYPHEN.sub("", text) if "-" in text else text


def words(text: str) -> list[str]:
    return _WORDS.findall(_THOUSANDS.sub("", plain(text).lower()))


def item_words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a passage and whether each is written as a name or figure."""
    p = plain(text)
    found = [(m[0], m.start()) for m in _CASED.finditer(p)]
    out, slot = [], []
    for w, at in found:
        before = p[max(0, at - 16) : at]
        # the first word of a sentence may have its capital from there; an initial ends none
        ended = bool(re.search(r"[.!?][\"')\]]*\s+$", before)) and not re.search(r"(?:^|[^A-Za-z])[A-Z]\.\s+$", before)
        first = not re.search(r"[A-Za-z0-9,;:]\W{0,2}$", before) or ended
        out.append(w.lower().replace(",", "").replace(".", ""))
        slot.append(w[0].isdigit() or (w[0].isupper() and not first))
    return out, slot


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


_UNIT_OF = {spelling: _hash(f"unit {unit}") for unit, spellings in UNITS.items() for spelling in spellings}


class Typer:
    """Types the words of texts by one vocabulary: sorted hashes of the words that belong to templates."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        """Forget the words seen; a number is given to each anew, under which its codes stand."""
        self.seen: dict[str, int] = {}
        self.code_of, self.hash_of, self.unit_of = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)

    def _add(self, word: str) -> int:
        n = self.seen[word] = len(self.seen) + 1
        if n == len(self.code_of):
            self.code_of, self.hash_of, self.unit_of = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code_of, self.hash_of, self.unit_of))
        h = _hash(word)
        code = h | 4
        if word[0].isdigit():
            code = NUMBER
        else:
            at = int(np.searchsorted(self.vocabulary, np.uint64(code)))
            if at == len(self.vocabulary) or int(self.vocabulary[at]) != code:
                code = NAME
        self.code_of[n], self.hash_of[n], self.unit_of[n] = code, h, _UNIT_OF.get(word, 0)
        return n

    def numbers(self, ws: list[str]) -> np.ndarray:
        if len(self.seen) > 1_000_000:
            self.clear()
        get, add = self.seen.get, self._add
        return np.array([get(w) or add(w) for w in ws], dtype=np.int64)

    def codes(self, ws: list[str]) -> np.ndarray:
        numbers = self.numbers(ws)  # may make the tables longer
        return self.code_of[numbers]

    def hashes(self, ws: list[str]) -> np.ndarray:
        numbers = self.numbers(ws)
        return self.hash_of[numbers]

    def slots(self, ws: list[str]) -> list[bool]:
        """Which words are names or figures."""
        return (self.codes(ws) <= NAME).tolist()

    def windows(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: hash of its template, hash of its slots, place of its first word, number of its template words."""
        return self.windows_of([ws])[1:]

    def windows_of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of many texts at once, with the number of their text first; none reaches over a text's end."""
        lengths = np.array([len(ws) for ws in texts], dtype=np.int64)
        numbers = self.numbers([w for ws in texts for w in ws])
        none = np.zeros(0, np.int64)
        if len(numbers) < WINDOW:
            return none, none.astype(np.uint64), none.astype(np.uint64), none, none
        text = np.repeat(np.arange(len(texts)), lengths)
        together = text[1:] == text[:-1]
        codes = self.code_of[numbers]
        values = np.where(codes <= NAME, self.hash_of[numbers], np.uint64(0))
        # a unit is one behind a number only
        unit = self.unit_of[numbers]
        unit[0], unit[1:] = 0, np.where((codes[:-1] == NUMBER) & together, unit[1:], 0)
        codes = np.where(unit > 0, np.uint64(UNIT), codes)
        values = np.where(unit > 0, unit, values)
        named = codes == NAME
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(named[1:] & named[:-1] & together)
        places = np.nonzero(keep)[0]
        # a run of names is known by its last word
        ends = np.append(places[1:], len(codes)) - 1
        tokens, held = codes[places], np.where(codes[places] == NAME, values[ends], values[places])
        n = len(tokens) - WINDOW + 1
        if n <= 0:
            return none, none.astype(np.uint64), none.astype(np.uint64), none, none
        template, slots, solid = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for k in range(WINDOW):
            template = _mixed(template, tokens[k : k + n])
            slots = _mixed(slots, held[k : k + n])
            solid += tokens[k : k + n] > UNIT
        of = text[places]
        within = np.nonzero(of[:n] == of[WINDOW - 1 :])[0]
        of, begins = of[within], np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return of, template[within], slots[within], places[within] - begins[of], solid[within]


def _mixed(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    h = (h * np.uint64(1_000_003) + part) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def item_windows(typer: Typer, ws: list[str]) -> list[tuple[int, int, int]]:
    """(template, slots, place) of the windows by which an item is found.

    Windows with a slot and at least two template words. Where RUN words in sequence could lie between
    two of these, those without a slot too, so that every run of an item holds a window.
    """
    template, slots, places, solid = typer.windows(ws)
    slotted = (solid >= 2) & (solid < WINDOW)
    at = np.concatenate([[-1], places[slotted], [len(ws) - WINDOW + 1]])
    gap = np.searchsorted(at, places, side="right")
    wide = at[np.minimum(gap, len(at) - 1)] - at[gap - 1] > RUN - WINDOW + 1
    return [(int(template[i]), int(slots[i]), int(places[i])) for i in np.nonzero(slotted | ((solid == WINDOW) & wide))[0].tolist()]


class Aligner:
    """One item, to be aligned with documents."""

    def __init__(self, typer: Typer, passage: str) -> None:
        self.words = item_words(passage)[0]
        self.slot = typer.slots(self.words)
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.hashes = typer.hashes(self.words)

    def covered(self, start: int, hashes: np.ndarray) -> bool:
        """Whether near a diagonal enough words of some run of the item are met at all, in whatever order.

        What a chain needs: it moves by one diagonal at a change, so it stays within DRIFT of where it met.
        """
        length = len(self.words)
        a = max(0, start - DRIFT)
        part = hashes[a : max(0, start + length + DRIFT)]
        if not len(part):
            return False
        row = np.zeros(length + 2 * DRIFT, dtype=np.uint64)
        row[a - start + DRIFT : a - start + DRIFT + len(part)] = part
        near = np.lib.stride_tricks.sliding_window_view(row, 2 * DRIFT + 1)
        met = np.concatenate([[0], np.cumsum((near == self.hashes[:, None]).any(axis=1))])
        run = min(RUN, length)
        return bool((met[run:] - met[:-run]).max() >= run - SPARE)

    def carried(self, starts: list[int], ws: list[str], hashes: np.ndarray) -> bool:
        """Whether around some place where the item would begin, a chain of its words is long enough."""
        length = len(self.words)
        need = min(RUN, length)
        starts = [s for s in sorted(starts) if self.covered(s, hashes)]
        if not starts:
            return False
        a = starts[0]
        for n, s in enumerate(starts):
            if n + 1 == len(starts) or starts[n + 1] - s > length:
                if self.longest(ws, a - length // 4, s + length + length // 4) >= need:
                    return True
                a = starts[n + 1] if n + 1 < len(starts) else s
        return False

    def longest(self, ws: list[str], start: int, end: int) -> int:
        """Words of the item spanned by the best chain within ws[start:end], 0 if too few are met."""
        places, slot = self.places, self.slot
        best = 0
        # at (i, j): first item word of the chain, words met
        rows: dict[int, dict[int, tuple[int, int]]] = {}
        for j in range(max(0, start), min(len(ws), end)):
            at = places.get(ws[j])
            row: dict[int, tuple[int, int]] = {}
            if at:
                one, two = rows.get(j - 1, {}), rows.get(j - 2, {})
                for i in at:
                    first, met = i, 0
                    for prev, back in ((one, 1), (two, 1), (two, 2), (one, 2)):
                        c = prev.get(i - back)
                        # a step over a word of the item is only allowed if it is no name or figure,
                        # a word added or put in its place only if it is no figure
                        if c and c[1] > met and not (back == 2 and slot[i - 1]) and not (prev is two and ws[j - 1].isdigit()):
                            first, met = c
                    row[i] = (first, met + 1)
                    span = i - first + 1
                    if span > best and met + 1 >= span - SPARE * max(1, span // RUN):
                        best = span
            rows[j] = row
            rows.pop(j - 3, None)
        return best


class Members:
    """A set of 64-bit keys: a sorted array, or a bit set that also holds some others."""

    def __init__(self, keys: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        self.keys, self.bits = keys, bits

    def among(self, keys: np.ndarray) -> np.ndarray:
        if self.keys is not None:
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            return self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        at = keys % np.uint64(len(self.bits) * 64)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def vocabulary(items: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that some item writes small and none as a name; counted over all items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(_hash(w) | 4, s) for p in batch.column(0).to_pylist() if p for w, s in zip(*item_words(p)) if not w[0].isdigit()}
            hashes = np.array([h for h, _ in seen], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array([s for _, s in seen], pa.bool_())], names=["h", "named"])

    words_ = items.select("passage").mapInArrow(run, "h bigint, named boolean").groupBy("h").agg(F.bool_or("named").alias("named")).where("not named").select("h")
    got = words_.limit(MAX_VOCABULARY + 1).toArrow()
    if got.num_rows > MAX_VOCABULARY:
        raise ValueError(f"the items write more than {MAX_VOCABULARY} words: that is no language")
    return np.sort(got.column("h").to_numpy().view(np.uint64))


def _key(template: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return _mixed(template, slots)


def members(windows: DataFrame) -> Members:
    """The keys of the items' windows, for all tasks."""
    keys = windows.select("key").distinct()
    got = keys.limit(MAX_KEYS + 1).toArrow()
    if got.num_rows <= MAX_KEYS:
        return Members(keys=np.sort(got.column("key").to_numpy().view(np.uint64)))
    bits = BITS
    # pmod of the signed key is that of the unsigned one, as the number of bits divides 2 ** 64
    at = F.pmod(F.col("key"), F.lit(bits))
    word = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[word.column("w").to_numpy()] = word.column("b").to_numpy().view(np.uint64)
    return Members(bits=table)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of every document that carries an item."""
    sc = documents.sparkSession.sparkContext
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("passage is not null and passage <> ''").distinct()
    words_of = sc.broadcast(vocabulary(items))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typer = Typer(words_of.value)
        for batch in batches:
            rows = [(t, s, item, place) for item, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, s, place in item_windows(typer, item_words(passage)[0])]
            t, s, item, place = zip(*rows) if rows else ((), (), (), ())
            template, slots = np.array(t, dtype=np.uint64), np.array(s, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(_key(template, slots))), pa.array(_signed(template)), pa.array(_signed(slots)), pa.array(item, pa.int64()), pa.array(place, pa.int32())], names=["key", "template", "slots", "item_id", "place"]
            )

    windows = cut(items.mapInArrow(index, "key bigint, template bigint, slots bigint, item_id bigint, place int"))
    known = sc.broadcast(members(windows))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typer, keys = Typer(words_of.value), known.value
        for batch in batches:
            ids, texts, hits = [], [], []
            held: list[tuple[int, list[str]]] = []
            waiting = 0
            for n, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                held.append((doc, words(text)))
                waiting += len(held[-1][1])
                if waiting < AT_ONCE and n < batch.num_rows:
                    continue
                of, template, slots, places, solid = typer.windows_of([ws for _, ws in held])
                met = np.nonzero((solid >= 2) & keys.among(_key(template, slots)))[0]
                found_in: dict[int, list] = {}
                for k, a, b, c in zip(of[met].tolist(), _signed(template[met]).tolist(), _signed(slots[met]).tolist(), places[met].tolist()):
                    found_in.setdefault(k, []).append({"template": a, "slots": b, "at": c})
                for k, got in found_in.items():
                    ids.append(held[k][0])
                    texts.append(" ".join(held[k][1]))
                    hits.append(got)
                held, waiting = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(hits, _HITS)], names=["doc_id", "words", "hits"])

    texts = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    hit = cut(texts.mapInArrow(look, "doc_id bigint, words string, hits array<struct<template:bigint,slots:bigint,at:int>>"))
    # the join of windows: template and slots must both agree
    at = hit.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.template", "h.slots", "h.at")
    met = at.join(windows.drop("key"), ["template", "slots"]).groupBy("doc_id", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    # one row per document, its items together: its words are sent and read once
    met = met.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "starts", "passage")).alias("met"))
    # alignment costs far more than its rows weigh, so it is spread by documents whatever the size of the join
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism)
    pairs = met.join(hit.select("doc_id", "words"), "doc_id").repartition(tasks, "doc_id")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typer, aligners = Typer(words_of.value), {}
        for batch in batches:
            docs, keys = [], []
            for doc, items_met, text in zip(*(c.to_pylist() for c in batch.columns)):
                ws = text.split(" ")
                hashes = typer.hashes(ws)
                for pair in items_met:
                    if (look := aligners.get(pair["passage"])) is None:
                        if len(aligners) > 10_000:
                            aligners.clear()
                        look = aligners[pair["passage"]] = Aligner(typer, pair["passage"])
                    if look.carried(pair["starts"], ws, hashes):
                        docs.append(doc)
                        keys.append(pair["item_id"])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "item_id"])

    return pairs.select("doc_id", "met", "words").mapInArrow(align, "doc_id bigint, item_id bigint").distinct()


_HITS = pa.list_(pa.struct([("template", pa.int64()), ("slots", pa.int64()), ("at", pa.int32())]))
