"""Texts in containers of fixed capacity, by pattern packing with non-negative least squares.

Sizes are tokens of a public tokenizer, counted once. A text larger than a capacity gives full pieces,
a container each, and a rest; no other text is divided. What is left to pack is a histogram of sizes,
never longer than the capacity whatever the corpus:

1. few-document patterns that fill a container exactly are enumerated (pairs of all sizes present, and
   triples, on a grid of the larger capacities);
2. how often each is to be repeated is fitted to the histogram by non-negative least squares
   (multiplicative updates from below keep all counts positive);
3. the counts are rounded down to what the histogram holds, and
4. the residual sizes are packed best-fit decreasing, whole groups of equal containers at a time.

The result is a plan of (sizes, repeats), whose length depends on the capacity alone. Documents find
their container by their rank among those of their size; ranks are counted within salted groups, so a
size that a third of all documents share is spread over :data:`SALTS` tasks.

Defined results: NULL and empty texts, and texts of no token, come out with no container; a document
given twice counts once; a capacity that is NULL or below 1 is ignored. Extra columns are never read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of that vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SALTS = 64
#: Triples are enumerated on a grid of about so many sizes.
GRID = 160
STEPS = 400
#: Weights of the sizes in the fits that are tried.
POWERS = (0.5, 2.0, 6.0)
#: Capacities are configuration. Classes are packed in groups: their capacities together bound the histogram that the
#: driver sees at once, their number the rows that a document makes at once. One capacity alone may be larger.
GROUP_CAPACITY = 4_000_000
GROUP_CLASSES = 256


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """Few-document patterns that fill a container exactly: rows of three sizes, 0 for none."""
    a = np.nonzero(have[: capacity + 1])[0]
    a = a[a > 0]
    out = []
    if capacity < len(have) and have[capacity]:
        out.append([capacity, 0, 0])
    pairs = a[(a <= capacity - a) & (have[capacity - a] > 0)]
    out += [[int(x), int(capacity - x), 0] for x in pairs]
    grid = a if len(a) <= GRID else a[np.unique(np.linspace(0, len(a) - 1, GRID).astype(int))]
    for i, x in enumerate(grid):
        rest = capacity - int(x) - grid[i:]
        third = (rest >= grid[i:]) & (rest > 0)
        third[third] &= have[rest[third]] > 0
        out += [[int(x), int(y), int(z)] for y, z in zip(grid[i:][third], rest[third])]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit(rows: np.ndarray, have: np.ndarray, power: float = 0.5, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that least miss the histogram (least squares).

    Short sizes weigh little, the less the greater ``power``: they are easily packed later.
    """
    n = len(have)
    weight = (np.arange(n, dtype=np.float64) / max(1, n - 1)) ** power + 0.05
    used = rows > 0

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows[used], weights=np.broadcast_to(x[:, None], rows.shape)[used], minlength=n)

    def transposed(y: np.ndarray) -> np.ndarray:
        return (y[rows] * used).sum(axis=1)

    target = transposed(weight * have)
    x = np.full(len(rows), max(1e-9, have.sum() / max(1, 3 * len(rows))))
    for _ in range(steps):
        x *= target / np.maximum(transposed(weight * times(x)), 1e-12)
    return x


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing over a histogram; containers of equal content are moved together."""
    room: dict[int, list[list]] = {}  # space left -> [sizes, containers]
    spaces: list[int] = []  # sorted keys of room

    def put(space: int, content: tuple[int, ...], n: int) -> None:
        if space not in room:
            room[space] = []
            spaces.insert(bisect_right(spaces, space), space)
        for g in room[space]:
            if g[0] == content:
                g[1] += n
                return
        room[space].append([content, n])

    done: Plan = []
    for size in range(capacity, 0, -1):
        count = int(left[size]) if size < len(left) else 0
        while count:
            at = bisect_right(spaces, size - 1)
            if at == len(spaces):
                # a new container takes as many of this size as fit
                each = capacity // size
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                count = 0
                break
            space = spaces[at]
            content, n = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(at)
            each = min(space // size, count)
            take = min(n, count // each)
            if take < n:
                put(space, content, n - take)
            put(space - each * size, content + (size,) * each, take)
            count -= take * each
        # closed containers need not be looked at again
        if 0 in room:
            done += [(tuple(g[0]), g[1]) for g in room.pop(0)]
            spaces.pop(0)
    for groups in room.values():
        done += [(g[0], g[1]) for g in groups]
    return done


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """(sizes of a container, repeats) that hold every counted size once.

    Of fits with different weights the one with the fewest containers is taken.
    """
    have = np.zeros(capacity + 1)
    for size, n in counts.items():
        have[size] = n
    rows = patterns(have, capacity)
    if not len(rows):
        return best_fit(have.astype(np.int64), capacity)
    made = [_rounded(rows, fit(rows, have, power), have.astype(np.int64), capacity) for power in POWERS]
    # no pattern at all is the fit of zeros: where most sizes exceed half a container it may be the best
    made.append(best_fit(have.astype(np.int64), capacity))
    return min(made, key=lambda m: sum(n for _, n in m))


def _rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    out: Plan = []
    for k in np.argsort(-x, kind="stable").tolist():
        sizes_, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(np.floor(x[k] + 1e-6), (left[sizes_] // each).min()))
        if n > 0:
            left[sizes_] -= n * each
            out.append((tuple(int(s) for s in sorted(rows[k][rows[k] > 0], reverse=True)), n))
    return out + best_fit(left, capacity)


class Places:
    """Of a plan, the container of the document of a rank among those of its size."""

    def __init__(self, made: Plan) -> None:
        self.starts: dict[int, list[int]] = {}
        self.entries: dict[int, list[tuple[int, int]]] = {}
        filled: dict[int, int] = {}
        first = 0
        for content, repeats in made:
            for size in sorted(set(content)):
                each = content.count(size)
                self.starts.setdefault(size, []).append(filled.get(size, 0))
                self.entries.setdefault(size, []).append((first, each))
                filled[size] = filled.get(size, 0) + repeats * each
            first += repeats
        self.containers = first

    def of(self, size: int, rank: int) -> int:
        starts = self.starts[size]
        k = bisect_right(starts, rank) - 1
        first, each = self.entries[size][k]
        return first + (rank - starts[k]) // each


def pack(counted: DataFrame, spec: DataFrame) -> DataFrame:
    """Every document's pieces and their containers, for every container class.

    ``counted`` has ``doc_id, n_tokens``. A class's containers are called p0, p1 and so on; full pieces
    of oversized texts have containers of their own, called d<document>.<piece>.
    """
    counted = cut(counted)
    out = None
    for classes in _groups(spec):
        got = _pack(counted, classes)
        out = got if out is None else out.unionByName(got)
    return _pack(counted, []) if out is None else out


def _groups(spec: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """All container classes, in groups of bounded capacity and number, read one by one."""
    group: list[tuple[str, int]] = []
    for r in spec.select("container_class", "capacity_tokens").where("capacity_tokens >= 1").distinct().orderBy("capacity_tokens", "container_class").toLocalIterator():
        if group and (len(group) == GROUP_CLASSES or sum(c for _, c in group) + r.capacity_tokens > GROUP_CAPACITY):
            yield group
            group = []
        group.append((r.container_class, r.capacity_tokens))
    if group:
        yield group


def _pack(counted: DataFrame, classes: list[tuple[str, int]]) -> DataFrame:
    spark = counted.sparkSession
    table = F.array(*[F.struct(F.lit(name).cast("string").alias("container_class"), F.lit(capacity).alias("capacity")) for name, capacity in classes]) if classes else F.array().cast("array<struct<container_class:string,capacity:int>>")
    every = counted.select("doc_id", "n_tokens", F.inline(table))
    every = every.withColumn("full", F.when(F.col("n_tokens") > F.col("capacity"), F.expr("n_tokens div capacity")).otherwise(F.lit(0)))
    every = every.withColumn("rest", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int"))

    group = ["container_class", "capacity", "rest"]
    rests = every.where("rest > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = rests.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("n"))
    salted = cut(salted.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))))
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in salted.groupBy(*group).agg(F.sum("n").alias("n")).collect():
        counts.setdefault((r.container_class, r.capacity), {})[r.rest] = r.n
    plans = spark.sparkContext.broadcast({name: plan(c, name[1]) for name, c in counts.items()})

    ranked = rests.withColumn("local", F.row_number().over(Window.partitionBy(*group, "salt").orderBy("doc_id")) - 1)
    ranked = ranked.join(salted.drop("n"), [*group, "salt"]).withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {name: Places(made) for name, made in plans.value.items()}
        for batch in batches:
            got = [places[c, cap].of(size, rank) for c, cap, size, rank in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(got, pa.int64())], names=["container_class", "capacity", "doc_id", "full", "n_tokens", "place"])

    packed = ranked.select("container_class", "capacity", "doc_id", F.col("full").cast("int"), F.col("rest"), F.col("rank").cast("bigint")).mapInArrow(
        place, "container_class string, capacity int, doc_id bigint, full int, n_tokens int, place bigint"
    )
    last = packed.select("container_class", "capacity", F.concat(F.lit("p"), F.col("place")).alias("container_id"), "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("capacity")).cast("bigint").alias("start_token"), "n_tokens")
    # a full piece's container is told by its document and number, without counting
    whole = every.where("full > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))))
    number = F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), F.col("piece_no"))
    whole = whole.select("container_class", "capacity", number.alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).cast("bigint").alias("start_token"), F.col("capacity").alias("n_tokens"))
    nothing = every.where("n_tokens = 0").select("container_class", "capacity", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens")
    return last.unionByName(whole).unionByName(nothing)
