"""Replacement of spans and the re-scan of the result."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left, bisect_right
from collections import Counter

from veilspark import lexicon as lx
from veilspark.operators.detect import Entity, Ner, detect
from veilspark.operators.policy import Decision, Profile, relevant
from veilspark.operators.reconcile import reconcile


class Vault:
    """Surrogates and digests of one run.

    Both are keyed by a salt drawn at random once per run, on the driver: equal values get equal ones in
    every task and in every attempt of a task, without a shuffle, and without the salt they tell nothing
    about the value. The tables of :mod:`veilspark.operators.vault` say which surrogate stands for which
    digest of a value.
    """

    def __init__(self, salt: bytes | None = None, rounds: int = lx.PBKDF2_ROUNDS) -> None:
        self.salt = salt if salt is not None else secrets.token_bytes(16)
        self.rounds = rounds
        self.digests: dict[str, str] = {}

    def tokenize(self, value: str, kind: str) -> str | None:
        if kind in lx.NEVER_TOKENIZED:
            return None
        return f"<{kind}:{surrogate_of(hashlib.sha256(value.encode()).hexdigest(), self.salt)}>"

    def digest(self, value: str, kind: str) -> str | None:
        if kind in lx.LOW_ENTROPY:
            return None
        if value not in self.digests:
            self.digests[value] = hashlib.pbkdf2_hmac("sha256", value.encode(), self.salt, self.rounds).hex()[:16]
        return self.digests[value]


def surrogate_of(digest: str, salt: bytes) -> str:
    """Sixteen bytes, in hex, that stand for a value's digest under a salt."""
    return hmac.new(salt, digest.encode(), "sha256").hexdigest()[:32]


def replacement(e: Entity, action: str, vault: Vault, warnings: list[str]) -> str | None:
    if action == "ALLOW":
        return None
    if action == "REPLACE":
        return f"[{e.type}]"
    if action == "MASK":
        return "*" * (8 if e.severity == "HIGH" else max(1, e.end - e.start))
    if action == "HASH":
        if digest := vault.digest(e.text, e.type):
            return f"[{e.type}:{digest}]"
        warnings.append(f"HASH refused for {e.type}; applied REDACT instead")
    if action == "TOKENIZE":
        if token := vault.tokenize(e.text, e.type):
            return token
        warnings.append(f"TOKENIZE refused for {e.type}; applied REDACT instead")
    return f"[REDACTED:{e.type}]"


def apply(text: str, decisions: list[Decision], vault: Vault) -> tuple[str | None, dict[str, int], list[str]]:
    """The rewritten text (None if some action is BLOCK), counts by action, warnings.

    Where spans nest, the outermost one absorbs what it holds with the strictest action among them, so
    no offset is used after the text under it has changed.
    """
    counts = dict(Counter(d.applied for d in decisions))
    if "BLOCK" in counts:
        return None, counts, []
    warnings: list[str] = []
    todo: list[list] = []
    for d in sorted((d for d in decisions if d.applied != "ALLOW"), key=lambda d: (d.entity.start, -d.entity.end)):
        if d.entity.start < 0 or d.entity.end > len(text):
            warnings.append(f"skipped {d.entity.type}: span [{d.entity.start},{d.entity.end}) is outside the content")
        elif todo and d.entity.start < todo[-1][1]:
            todo[-1][1] = max(todo[-1][1], d.entity.end)
            todo[-1][3] = lx.strictest(todo[-1][3], d.applied)
        else:
            todo.append([d.entity.start, d.entity.end, d.entity, d.applied])
    parts, at = [], 0
    for a, b, e, action in todo:
        parts += [text[at:a], replacement(e, action, vault, warnings) or ""]
        at = b
    return "".join([*parts, text[at:]]), counts, warnings


# --- verification --------------------------------------------------------------------------------------

_TYPE, _DIGEST = r"[A-Z][A-Z0-9_]{2,40}", r"[0-9a-f]{8,64}"
#: What :func:`replacement` writes, for any type, and the mark of a blocked span.
MARKER = re.compile(rf"\[(?:(?:REDACTED|BLOCKED):{_TYPE}|{_TYPE}(?::{_DIGEST})?)\]|<{_TYPE}:{_DIGEST}>|\*{{2,}}")


class Masked:
    """A rewritten text with its markers blanked, each character in its place."""

    def __init__(self, text: str) -> None:
        found = [m.span() for m in MARKER.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.text = MARKER.sub(lambda m: " " * len(m[0]), text) if found else text

    def touches(self, start: int, end: int) -> bool:
        """Whether nothing but blanks lies between a span and the nearest marker before or after it."""
        after, before = bisect_left(self.starts, end), bisect_right(self.ends, start) - 1
        gaps = [(end, self.starts[after])] if after < len(self.starts) else []
        gaps += [(self.ends[before], start)] if before >= 0 else []
        return any(not self.text[a:b].strip() for a, b in gaps)


def has_substance(text: str) -> bool:
    """Three letters or digits at least, and no more blanks than characters."""
    blanks = sum(map(str.isspace, text))
    return sum(map(str.isalnum, text)) >= 3 and 2 * blanks <= len(text)


def verify(text: str, profile: Profile, permitted: dict[str, int], actioned: set[str], ner: Ner | None = None) -> list[Entity]:
    """Entities of the types acted on that are still there, beyond what policy let stand."""
    if not text.strip():
        return []
    masked = Masked(text)
    again = reconcile(relevant(detect(masked.text, 0.0, ner, profile.types), profile))[0]
    left = [e for e in again if e.type in actioned and has_substance(e.text) and not masked.touches(e.start, e.end)]
    # of every type the first ones, as many as policy let stand, are those that may
    seen: Counter[str] = Counter()
    out = []
    for e in left:
        seen[e.type] += 1
        if seen[e.type] > permitted.get(e.type, 0):
            out.append(e)
    return out
