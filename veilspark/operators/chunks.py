"""Windows of a text that reach back by an overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import lexicon as lx


def overlap_of(span: int) -> int:
    return max(lx.MIN_OVERLAP, int(span * 1.25))


def size_of(overlap: int, requested: int | None = None) -> int:
    return max(requested or lx.BASE_CHUNK, 4 * overlap)


def chunks(text: str, span: int, requested: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of every chunk; it is cut after a line end in the last fifth, if there is one."""
    overlap = overlap_of(span)
    size = size_of(overlap, requested)
    if len(text) <= size:
        return [(0, len(text), 0)]
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            line = text.rfind("\n", max(at + 1, end - max(1, size // 5)), end)
            end = line + 1 if line >= 0 else end
        else:
            end = len(text)
        start = max(0, at - overlap)
        out.append((start, end, at - start))
        at = end
    return out


def novel(text: str, parts: list[tuple[int, int, int]]) -> str:
    """The parts of all chunks after their overlaps: the text again."""
    return "".join(text[a + o : b] for a, b, o in parts)


def line_of(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the line begins and ends that holds a span (T8); a span over several lines takes them all."""
    stop = text.find("\n", end)
    return text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop


def line_column(text: Column, start: Column, end: Column) -> Column:
    """The same in the JVM: the text of the line or lines around a span."""
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    after = F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)
    return F.concat(before, F.substring(text, start + 1, end - start), after)
