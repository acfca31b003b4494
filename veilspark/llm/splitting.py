"""Oversized items in pieces under a limit, cut at natural boundaries, by agglomerative merging.

The limit of a scan follows from its options and profiles: the span is the largest among the named
profiles and all they inherit; the overlap is ``max(4096, span * 5 / 4)`` rounded down; the size is
``max(requested or 8192, 4 * overlap)``, in code points. A text longer than the size is taken apart at
every boundary it has (paragraph, line, sentence, clause or blank; hard cuts only inside a stretch
longer than a piece that has none). The boundaries between neighbours wait in a heap; the weakest is
merged first, of equally weak ones the pair with the least combined size, as long as the pair plus the
overlap fits. What fits no more stays a cut.

Every piece begins ``overlap`` code points before the end of the one before (the first at 0), is at most
``size`` long, and the parts after the overlaps joined give the text. Since a first piece shorter than
the overlap always merges with its neighbour, no overlap is cut short.

Defined results: NULL or short content has no case and comes out as one piece or none; unknown profile
names and cycles of inheritance are ignored; no profiles means a span of 0; a chunk size of NULL or 0
means none requested; replayed scans and records count once. Extra columns are never read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import cut

MIN_OVERLAP = 4096
BASE_SIZE = 8192
SIZE_PER_OVERLAP = 4
#: Profiles are configuration; a table beyond this is not collected but joined with itself until nothing changes.
MAX_PROFILES = 100_000

PARAGRAPH, LINE, SENTENCE, CLAUSE, HARD = 4, 3, 2, 1, 0
_BREAKS = re.compile(
    r"(?P<p>\n[ \t]*(?:\r?\n[ \t]*)+|\r\n[ \t]*(?:\r\n[ \t]*)+)|(?P<l>\r?\n)|(?P<s>[.!?…]+[\"'”’)\]]*[ \t]+|[。！？；]+[」』”]?|[\]}],(?=[\[{]))|(?P<c>[,;:、，][ \t]*|[ \t]+)"
)
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE}


def overlap_of(span: int) -> int:
    return max(MIN_OVERLAP, int(span * 1.25))


def size_of(requested: int | None, overlap: int) -> int:
    return max(requested or BASE_SIZE, SIZE_PER_OVERLAP * overlap)


def _safe(text: str, at: int) -> int:
    """The nearest place at or before ``at`` that splits no line end and no letter from its accents."""
    low = max(1, at - 64)
    while at > low and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or (text[at] == "\n" and text[at - 1] == "\r")):
        at -= 1
    return at


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the strength of the boundary at each end.

    Segments end at paragraphs, lines and sentences; one longer than ``most`` also at clauses and
    blanks; what is still longer is cut hard.
    """
    ends: list[int] = []
    strengths: list[int] = []
    weak: list[tuple[int, int]] = []
    start = 0

    def close(end: int, strength: int) -> None:
        nonlocal start, weak
        if end - start > most:
            # take in the clause boundaries, then hard cuts
            for at, s in [*weak, (end, strength)]:
                while at - start > most:
                    cut = _safe(text, start + most)
                    ends.append(cut)
                    strengths.append(HARD)
                    start = cut
                if at > start:
                    ends.append(at)
                    strengths.append(s)
                    start = at
        else:
            ends.append(end)
            strengths.append(strength)
            start = end
        weak = []

    for m in _BREAKS.finditer(text):
        strength = _STRENGTH[m.lastgroup]
        if strength == CLAUSE:
            weak.append((m.end(), CLAUSE))
        elif m.end() > start:
            close(m.end(), strength)
    if start < len(text):
        close(len(text), PARAGRAPH)
    return ends, strengths


def cuts(text: str, size: int, overlap: int) -> list[int]:
    """Ends of the pieces of a text; one end if it fits."""
    n = len(text)
    if n <= size:
        return [n]
    most = size - overlap
    ends, strengths = atoms(text, most)
    count = len(ends)
    starts = [0, *ends[:-1]]
    left, right = list(range(-1, count - 1)), list(range(1, count + 1))
    alive = [True] * count
    heap = [(strengths[i], ends[i + 1] - starts[i], i, i + 1, ends[i + 1]) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        strength, combined, i, j, end = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or ends[j] - starts[i] != combined or right[i] != j or ends[j] != end:
            continue  # an older state of this pair
        if combined + (overlap if starts[i] else 0) > size:
            continue  # pieces only grow: it never fits again
        alive[j] = False
        ends[i], strengths[i], right[i] = ends[j], strengths[j], right[j]
        if right[j] < count:
            k = right[j]
            left[k] = i
            heapq.heappush(heap, (strengths[i], ends[k] - starts[i], i, k, ends[k]))
        if left[i] >= 0:
            h = left[i]
            heapq.heappush(heap, (strengths[h], ends[i] - starts[h], h, i, ends[i]))
    return [ends[i] for i in range(count) if alive[i]]


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece, with its overlap."""
    out, before = [], 0
    for end in cuts(text, size, overlap):
        out.append((max(0, before - overlap), end))
        before = end
    return out


def spans_of(rows: list) -> dict[str, int]:
    """Of every profile (name, inherits, span) the largest span among it and all it inherits."""
    own: dict[str, int] = {}
    parents: dict[str, set] = {}
    for r in rows:
        own[r.profile_name] = max(own.get(r.profile_name, 0), r.max_pattern_span or 0)
        parents.setdefault(r.profile_name, set()).update(p for p in r.inherits or [] if p)

    def largest(name: str) -> int:
        seen, todo, most = {name}, [name], 0
        while todo:
            at = todo.pop()
            most = max(most, own.get(at, 0))
            new = {p for p in parents.get(at, ()) if p in own} - seen
            seen |= new
            todo += new
        return most

    return {name: largest(name) for name in own if name is not None}


def span_table(profiles: DataFrame) -> DataFrame:
    """``name, span`` of every profile: the largest span among it and all it inherits."""
    spark = profiles.sparkSession
    rows = profiles.select("profile_name", "inherits", "max_pattern_span").limit(MAX_PROFILES + 1).collect()
    if len(rows) <= MAX_PROFILES:
        return F.broadcast(spark.createDataFrame(sorted(spans_of(rows).items()) or [("", 0)], "name string, span int"))
    named = profiles.where("profile_name is not null")
    spans = cut(named.groupBy(F.col("profile_name").alias("name")).agg(F.coalesce(F.max("max_pattern_span"), F.lit(0)).alias("span")))
    edges = cut(named.select(F.col("profile_name").alias("name"), F.explode("inherits").alias("parent")).where("parent is not null").distinct())
    while True:
        # the largest span goes down one generation at a time; cycles settle, since it only grows
        handed = edges.join(spans.select(F.col("name").alias("parent"), "span"), "parent").groupBy("name").agg(F.max("span").alias("from_above"))
        new = cut(spans.join(handed, "name", "left").select("name", F.greatest("span", F.coalesce("from_above", F.lit(0))).alias("span"), (F.coalesce("from_above", F.lit(0)) > F.col("span")).alias("grew")))
        spans = new.select("name", "span")
        if new.where("grew").isEmpty():
            return spans


def limits(scans: DataFrame, profiles: DataFrame) -> DataFrame:
    """``scan_id, record_id, size, overlap`` of every scan; a replayed scan once."""
    named = scans.select("scan_id", F.explode_outer("profile_names").alias("name")).join(span_table(profiles), "name", "left")
    span = named.groupBy("scan_id").agg(F.coalesce(F.max("span"), F.lit(0)).alias("span"))
    one = scans.select("scan_id", "record_id", "chunk_size").groupBy("scan_id", "record_id").agg(F.max("chunk_size").alias("chunk_size"))
    overlap = F.greatest(F.lit(MIN_OVERLAP), F.floor(F.col("span") * 1.25).cast("int"))
    requested = F.when(F.coalesce("chunk_size", F.lit(0)) > 0, F.col("chunk_size")).otherwise(F.lit(BASE_SIZE))
    return one.join(span, "scan_id").withColumn("overlap", overlap).withColumn("size", F.greatest(requested, SIZE_PER_OVERLAP * F.col("overlap"))).select("scan_id", "record_id", "size", "overlap")


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [("record_id", pa.int64()), ("size", pa.int32()), ("overlap", pa.int32()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string())]
    for batch in batches:
        cols: list[list] = [[] for _ in types]
        for rid, size, overlap, text in zip(*(c.to_pylist() for c in batch.columns)):
            for n, (a, b) in enumerate(pieces(text, size, overlap), 1):
                for c, v in zip(cols, (rid, size, overlap, n, a, b, text[a:b])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], schema=pa.schema(types))


PIECE = "record_id bigint, size int, overlap int, piece_no int, start_pos int, end_pos int, text string"


def split_scans(content: DataFrame, scans: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces of every oversized record for every size asked of it, and the scans' limits.

    Only content that can be oversized is joined, and each record is split once for all scans of one
    size and overlap.
    """
    limit = limits(scans, profiles)
    asked = limit.select("record_id", "size", "overlap").distinct()
    smallest = SIZE_PER_OVERLAP * MIN_OVERLAP
    long = content.where(F.char_length("content") > smallest).select("record_id", "content", "ingested_at")
    long = long.groupBy("record_id").agg(F.max_by("content", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("content"))
    todo = long.join(asked, "record_id").where(F.char_length("content") > F.col("size"))
    return todo.select("record_id", "size", "overlap", "content").mapInArrow(_split, PIECE), limit


def oversized(content: DataFrame, scans: DataFrame, profiles: DataFrame) -> DataFrame:
    """``scan_id, record_id`` of every scan whose record comes out in more than one piece."""
    made, limit = split_scans(content, scans, profiles)
    many = made.where("piece_no = 2").select("record_id", "size", "overlap").distinct()
    return limit.join(many, ["record_id", "size", "overlap"]).select("scan_id", "record_id").distinct()
