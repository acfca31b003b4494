"""Visually identical text in one consistent form, by script-aware repair.

Every text comes out with ordinary spaces, ASCII for full-width forms, no invisible characters and
composed accents. Then each token (a run of letters) is repaired by its scripts: letters that have no
twin in another script tell the dominant one; if there are none, the neighbouring tokens do. Only
tokens of mixed script, or wholly of look-alikes amid another script, are touched, and only when the
result exists in the corpus vocabulary: it stands somewhere in the corpus in plain form, or at least
two different spellings of the corpus lead to it. Accents, case, superscripts, fractions and ligature
signs are visible differences and stay.

Every non-ASCII text is read once (:func:`marked`) and written with the repairs it wants. The vocabulary test
covers all texts: wanted repairs are counted by their spellings; those with one spelling are looked for in
every text, against a broadcast table while that is at most :data:`MAX_BROADCAST` repairs, else by a
semi-join of the exploded tokens. Which repairs a text may have is then joined to it, all at once: a repair
never changes what another one sees. ASCII texts are their own form and never go to Python.

Texts that look the same form a class (:func:`classes`: one row per text with its class and the class's
size); pairs are made of a class's different texts and then expanded to their rows.

Defined results: NULL stays NULL, an empty text stays empty. Identical stored texts are no case; rows of a
NULL group are in no class.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import folding as fd
from veilspark.session import cut

#: Repairs sent to every task at most (about 40 MB); beyond it they are joined.
MAX_BROADCAST = 500_000
NON_ASCII = r"[^\x00-\x7F]"


def repairs(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, spelling, repair) of every token of a :func:`folding.plain` text that script rules would change."""
    if text.isascii():
        return []
    tokens = [(m.start(), m.end(), m[0]) for m in fd.WORD.finditer(text)]
    targets = [None] * len(tokens)
    out = []
    for n, (start, end, token) in enumerate(tokens):
        if token.isascii() or not any(c in fd.LOOKALIKE for c in token):
            # a plain token; only a Cyrillic or Greek one with Latin letters in it needs repair
            if token.isascii() or not re.search("[A-Za-z]", token) or fd.token_target(token) not in "CG":
                continue
        target = fd.token_target(token)
        if not target:
            target = _neighbours(tokens, targets, n)
        if target == "L":
            new = "".join(fd.LOOKALIKE.get(c, c) for c in token)
        elif target in ("C", "G"):
            table = fd.TO_CYRILLIC if target == "C" else fd.TO_GREEK
            new = "".join(table.get(c, c) for c in token)
        else:
            continue
        if new != token:
            out.append((start, end, token, new))
    return out


def _neighbours(tokens: list, targets: list, n: int) -> str:
    """The script of the nearest tokens around n that have one; Latin wins a tie."""
    for d in range(1, len(tokens)):
        near = []
        for k in (n - d, n + d):
            if 0 <= k < len(tokens):
                if targets[k] is None:
                    targets[k] = fd.token_target(tokens[k][2])
                near.append(targets[k])
        if "L" in near:
            return "L"
        if any(near):
            return next(x for x in near if x)
    return "L"


def canonical(text: str | None, known) -> str | None:
    """The consistent form of a text; ``known`` tells the repairs that exist in the corpus."""
    if not text or text.isascii():
        return text
    text = fd.plain(text)
    return repaired(text, [(start, end, new) for start, end, _, new in repairs(text) if new in known])


def repaired(plain: str, accepted: list[tuple[int, int, str]]) -> str:
    """A plain text with repairs put in, in order."""
    parts, at = [], 0
    for start, end, new in accepted:
        parts += [plain[at:start], new]
        at = end
    # a repaired letter may compose with an accent that its twin could not take
    return unicodedata.normalize("NFC", "".join([*parts, plain[at:]])) if parts else plain


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each batch."""
    for batch in batches:
        got = {word for text in batch.column(0).to_pylist() if text for word in fd.WORD.findall(fd.plain(text))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.string())], names=["repair"])


_MARKED = pa.schema([
    ("src", pa.string()), ("g", pa.string()), ("key", pa.int64()), ("stored", pa.binary()), ("plain", pa.string()), ("form", pa.binary()),
    ("wanted", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("spelling", pa.string()), ("repair", pa.string())]))),
])
_MARKED_DDL = "src string, g string, key bigint, stored binary, plain string, form binary, wanted array<struct<start:int,end:int,spelling:string,repair:string>>"


def _mark(whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, g, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                plain = fd.plain(text)
                wanted = repairs(plain)
                rows.append({
                    "src": src, "g": g, "key": key, "stored": _digest(text), "plain": plain if wanted or whole else None, "form": None if wanted else _digest(plain),
                    "wanted": [{"start": a, "end": b, "spelling": old, "repair": new} for a, b, old, new in wanted],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_MARKED)

    return run


def marked(texts: DataFrame, whole: bool = False) -> DataFrame:
    """The non-ASCII rows of ``texts`` (src, g, key, text) with the repairs each wants, written once; a text that wants
    none has its form already, and its plain text only if ``whole``. ``g`` names a row's group."""
    odd = texts.where(F.col("text").rlike(NON_ASCII)).select("src", "g", F.col("key").cast("bigint"), "text")
    return cut(odd.mapInArrow(_mark(whole), _MARKED_DDL).dropDuplicates(["src", "g", "key", "stored"]))


def vocabulary(texts: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """The repairs (one column ``repair``) wanted by some text that exist in the corpus: the column ``text`` of ``texts``."""
    if odd is None:
        odd = marked(texts.select(F.lit("").alias("src"), F.lit("").alias("g"), F.monotonically_increasing_id().alias("key"), F.col(texts.columns[0]).alias("text")))
        texts = texts.select(F.col(texts.columns[0]).alias("text"))
    wanted = odd.select(F.explode("wanted").alias("w")).select("w.repair", "w.spelling")
    counted = cut(wanted.groupBy("repair").agg(F.count_distinct("spelling").alias("n")))
    many = counted.where("n >= 2").select("repair")
    single = counted.where("n < 2").select("repair")
    all_texts = texts.where(F.col("text").isNotNull()).select("text")
    if single.count() <= MAX_BROADCAST:
        table = texts.sparkSession.sparkContext.broadcast(frozenset(r.repair for r in single.toLocalIterator()))

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = set(table.value)
            words = fd.WORD.findall
            for batch in batches:
                got = set()
                if left:
                    for text in batch.column(0).to_pylist():
                        if text:
                            got |= left.intersection(words(fd.plain(text)))
                    left -= got
                yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.string())], names=["repair"])

        seen = all_texts.mapInArrow(look, "repair string")
    else:
        seen = all_texts.mapInArrow(_tokens, "repair string").join(single, "repair", "left_semi")
    return many.unionByName(seen).distinct()


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def digest_of(value: Column) -> Column:
    """The digest that :func:`marked` makes, of a stored text as it is."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def formed(odd: DataFrame, known: DataFrame, whole: bool = False) -> DataFrame:
    """``src, g, key, stored, form`` of marked rows, with the ``canonical`` text if ``whole``: the repairs that exist are
    joined to the rows that want them, and made together."""
    keys = ["src", "key", "stored"]
    asked = odd.where(F.size("wanted") > 0).select(*keys, F.explode("wanted").alias("w")).select(*keys, "w.start", "w.end", "w.repair")
    granted = asked.join(known, "repair").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "end", "repair"))).alias("granted"))
    every = odd.join(granted, keys, "left").select("src", "g", "key", "stored", "plain", "form", "granted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, texts = [], []
            for plain, form, got in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6))):
                text = plain if form is not None or not got else repaired(plain, [(g["start"], g["end"], g["repair"]) for g in got])
                forms.append(form if form is not None else _digest(text))
                texts.append(text if whole else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(forms, pa.binary()), pa.array(texts, pa.string())], names=["src", "g", "key", "stored", "form", "canonical"])

    out = every.mapInArrow(run, "src string, g string, key bigint, stored binary, form binary, canonical string")
    return out if whole else out.drop("canonical")


def consistent(texts: DataFrame) -> DataFrame:
    """``src, key, canonical`` of every row of ``texts`` (src, key, text) that is not ASCII: its consistent form."""
    odd = marked(texts.withColumn("g", F.lit("")), whole=True)
    return formed(odd, cut(vocabulary(texts, odd)), whole=True).select("src", "key", "stored", "canonical")


def members(rows: DataFrame) -> DataFrame:
    """``src, g, form, stored, key`` of all texts whose form some text of their group has that is not ASCII.

    ``rows`` has src, g, key and text; only within a group are texts compared, and rows without one are in no
    class, but their texts belong to the corpus whose vocabulary is asked. Of the ASCII texts just those are
    kept whose digest is the form of another one.
    """
    rows = rows.where(F.col("text").isNotNull()).withColumn("key", F.col("key").cast("bigint"))
    odd = marked(rows)
    odd_rows = cut(formed(odd, cut(vocabulary(rows.select("text"), odd))).where(F.col("g").isNotNull()).select(*_AT, "stored", "key"))
    value = F.col("text")
    plain = rows.where(~value.rlike(NON_ASCII) & F.col("g").isNotNull()).select("src", "g", digest_of(value).alias("form"), digest_of(value).alias("stored"), "key")
    plain = plain.join(odd_rows.select(*_AT).distinct(), _AT, "left_semi").distinct()
    return cut(odd_rows.unionByName(plain))


_AT = ["src", "g", "form"]


def classes(found: DataFrame) -> DataFrame:
    """``src, key, class_id, n_texts, n_rows`` of every row in a class of at least two different texts; counts are
    taken by text first, so a text of many copies is one row when they are."""
    texts = found.groupBy(*_AT, "stored").agg(F.count(F.lit(1)).alias("n"))
    sizes = texts.groupBy(*_AT).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_rows")).where("n_texts > 1")
    name = F.substring(F.sha2(F.concat_ws("|", "src", "g", F.hex("form")), 256), 1, 32)
    return found.join(sizes, _AT).select("src", "key", name.alias("class_id"), "n_texts", "n_rows")


def pairs(found: DataFrame) -> DataFrame:
    """``src, key_a, key_b`` (key_a < key_b) of different stored texts of one class.

    Different texts of a class are paired first, then expanded to their rows: a class of many copies makes
    no other pairs than those of the result.
    """
    texts = found.select(*_AT, "stored").distinct()
    both = texts.withColumnRenamed("stored", "stored_a").join(texts.withColumnRenamed("stored", "stored_b"), _AT).where("stored_a < stored_b")
    left = found.withColumnRenamed("stored", "stored_a").withColumnRenamed("key", "_a")
    right = found.withColumnRenamed("stored", "stored_b").withColumnRenamed("key", "_b")
    out = both.join(left, [*_AT, "stored_a"]).join(right, [*_AT, "stored_b"]).where("_a <> _b")
    return out.select("src", F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()


def grouped(content: DataFrame, fields: DataFrame) -> DataFrame:
    """The rows of both tables that are compared: fields of a record, records of a source of a workspace."""
    # concat is NULL where a part is
    of_content = content.select(F.lit("content").alias("src"), F.concat("workspace_id", F.lit("\n"), "source_identifier").alias("g"), F.col("record_id").alias("key"), F.col("content").alias("text"))
    of_fields = fields.select(F.lit("field").alias("src"), F.col("record_id").cast("string").alias("g"), F.col("field_id").alias("key"), F.col("value").alias("text"))
    return of_content.unionByName(of_fields)


def look_alike_pairs(content: DataFrame, fields: DataFrame) -> DataFrame:
    """All pairs of fields of a record, and of records of a source, that look the same but differ."""
    return pairs(members(grouped(content, fields)))


def look_alike_classes(content: DataFrame, fields: DataFrame) -> DataFrame:
    """The same as classes: one row per row of the tables that looks like a different one."""
    return classes(members(grouped(content, fields)))
