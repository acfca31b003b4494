"""Normalisation with a map back to the stored offsets."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import lexicon as lx


def _bases() -> dict[str, str]:
    """Letters with marks whose first decomposed character is an ASCII letter or digit."""
    out = {}
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = unicodedata.normalize("NFD", c)[0]
            if base.isascii() and base.isalnum():
                out[c] = base
    return out


FOLDS = _bases() | lx.HOMOGLYPHS
_TABLE = {ord(k): v for k, v in FOLDS.items()} | dict.fromkeys(map(ord, lx.INVISIBLE))
#: Four single characters or more with one blank between each and the next, on their own.
SPACED_RUN = r"(?<![0-9A-Za-z-])[0-9A-Za-z-](?:[ \t][0-9A-Za-z-]){3,}(?![0-9A-Za-z-])"
_SPACED = re.compile(SPACED_RUN)
_GONE = re.compile("[" + re.escape(lx.INVISIBLE) + "]")
_FOLDED = re.compile("[" + re.escape("".join(FOLDS)) + "]")


def normalize(text: str) -> tuple[str, list[int] | None]:
    """Normalised text, and the stored position of each of its characters where they moved."""
    if text.isascii():
        return text, None
    out = text.translate(_TABLE)
    if len(out) == len(text):
        return out, None
    return out, [i for i, c in enumerate(text) if c not in lx.INVISIBLE]


def signals(text: str) -> list[str]:
    """What the normalisation says about evasion."""
    if text.isascii():
        return []
    gone, folded = len(_GONE.findall(text)), len(_FOLDED.findall(text))
    out = []
    if gone:
        out.append(f"{gone} zero-width or bidirectional control character(s) removed")
    if folded:
        out.append(f"{folded} homoglyph(s) folded to ASCII")
    return out


def collapse_spaced(text: str) -> tuple[str, list[int] | None]:
    """Blanks dropped inside runs of single characters only; positions as above, None if nothing changed."""
    drop = {i for m in _SPACED.finditer(text) for i in range(m.start(), m.end()) if text[i] in " \t"}
    if not drop:
        return text, None
    keep = [i for i in range(len(text)) if i not in drop]
    return "".join(text[i] for i in keep), keep


def without_whitespace(text: str) -> tuple[str, list[int] | None]:
    """The text without any whitespace (T5); positions as above, None if there was none."""
    keep = [i for i, c in enumerate(text) if not c.isspace()]
    return (text, None) if len(keep) == len(text) else ("".join(text[i] for i in keep), keep)


def original_span(positions: list[int] | None, start: int, end: int, length: int) -> tuple[int, int]:
    if positions is None:
        return start, min(end, length)
    return positions[start], min(positions[end - 1] + 1, length)


# the same as native expressions, for whole columns


def normalized_column(text: Column) -> Column:
    """T1 in the JVM: ``translate`` folds the characters it has a partner for and deletes the others."""
    return F.translate(text, "".join(FOLDS) + lx.INVISIBLE, "".join(FOLDS.values()))


def invisible_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, lx.INVISIBLE, ""))


def homoglyph_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(FOLDS), ""))


def collapsed_column(text: Column) -> Column:
    """T4 in the JVM: the pieces between runs, and the runs without their blanks, in turn."""
    runs, pieces = F.regexp_extract_all(text, F.lit(SPACED_RUN), F.lit(0)), F.split(text, SPACED_RUN, -1)
    tight = F.transform(runs, lambda r: F.regexp_replace(r, r"[ \t]", ""))
    joined = F.array_join(F.zip_with(pieces, tight, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(text.rlike(SPACED_RUN), joined).otherwise(text)


def without_whitespace_column(text: Column) -> Column:
    """T5 in the JVM."""
    return F.regexp_replace(text, r"\s", "")
