"""Typed spans of a text (D1-D10): labels, key prefixes, structures, checksums, context, joined runs.

One walk over the assignments of a text (``name: value``, ``name = value``) looks every name up in the
label table and tries the shapes its values may have, so the cost does not grow with the number of
labels. Keys with an issuer's prefix, private key blocks, web tokens, headers, addresses with a password
and card tracks have scanners of their own; general types have patterns.

Span = the whole match with its label; offsets are code points of the stored text. A match's score is
its rule's, raised by 0.35 (1.0 at most) if a context word of its type stands in the token where the
match starts or in the five tokens before it. Checksums set the score to 1.0 or reject.

Defined results: NULL, empty and blank text have no detection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from veilspark import lexicon as lx
from veilspark.operators.normalize import collapse_spaced, normalize, original_span


@dataclass
class Entity:
    type: str
    start: int
    end: int
    confidence: float
    text: str
    confidence_source: str = "CALIBRATED"
    detected_by: list[str] = field(default_factory=list)
    is_base_security: bool = False
    trimmed: bool = False

    @property
    def severity(self) -> str:
        return lx.severity(self.type)

    def moved(self, by: int) -> Entity:
        return replace(self, start=self.start + by, end=self.end + by, detected_by=list(self.detected_by))


# --- checksums ---------------------------------------------------------------------------------------


def luhn_ok(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text: str) -> bool:
    s = re.sub(r"[ \-]", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def aba_ok(text: str) -> bool:
    d = [int(c) for c in text if c in "0123456789"]
    return len(d) == 9 and any(d) and sum(x * w for x, w in zip(d, (3, 7, 1) * 3)) % 10 == 0


def dea_ok(text: str) -> bool:
    d = [int(c) for c in text[2:]]
    return len(d) == 7 and (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


#: True: score 1.0; False: no entity; None: the rule's score stands.
VALIDATORS: dict[str, Callable[[str], bool | None]] = {
    "CREDIT_CARD": luhn_ok, "IBAN_CODE": iban_ok, "ROUTING_NUMBER": aba_ok, "MEDICAL_LICENSE": dea_ok,
    "PHONE_NUMBER": lambda s: None if 10 <= sum(c.isdigit() for c in s) <= 15 else False,
}

#: (type, start, end, score)
Hit = tuple[str, int, int, float]

# --- labels ------------------------------------------------------------------------------------------

#: A word and the mark of an assignment behind it; a word is never tried from its middle.
_ASSIGNED = re.compile(r"\b(\w{1,64}+)[ \t]{0,4}[:=][ \t]{0,4}")
_WORD_BEFORE = re.compile(r"\b(\w{1,64})[- ]\Z")


def _plain(name: str) -> str:
    return re.sub(r"[_\- ]", "", name).lower()


@dataclass(frozen=True)
class _Announced:
    type: str
    spaced: bool
    shapes: tuple[tuple[re.Pattern, float], ...]


_LABELS: dict[str, list[_Announced]] = {}
#: Last words of labels; nothing else before a mark is looked at.
_ENDINGS: set[str] = set()
for _label in lx.LABELS:
    _shapes = tuple((re.compile(rf"[\"']?(?:{shape})[\"']?", re.IGNORECASE), score) for shape, score in _label.shapes)
    for _name in _label.names:
        _LABELS.setdefault(_plain(_name), []).append(_Announced(_label.type, _label.spaced, _shapes))
        _words = _name.split()
        _ENDINGS.update(_plain("".join(_words[k:])) for k in range(len(_words)))


def _labelled(text: str) -> Iterator[Hit]:
    """Values whose label stands before a mark; of every type the longest label that ends there."""
    for m in _ASSIGNED.finditer(text):
        name, start, spaced = _plain(m[1]), m.start(), False
        if name not in _ENDINGS:
            continue
        met: dict[str, list[Hit]] = {}
        while True:
            for a in _LABELS.get(name, ()):
                if a.spaced or not spaced:
                    ends = [(shape.match(text, m.end()), score) for shape, score in a.shapes]
                    met[a.type] = [(a.type, start, got.end(), score) for got, score in ends if got]
            before = _WORD_BEFORE.search(text, max(0, start - 65), start)
            if not before:
                break
            name, spaced, start = _plain(before[1]) + name, spaced or text[start - 1] == " ", before.start(1)
            if name not in _ENDINGS and name not in _LABELS:
                break
        for found in met.values():
            yield from found


_LOOSE = [
    (kind, re.compile(rf"\b(?:{'|'.join(lx.name_pattern(n) for n in sorted(names, key=len, reverse=True))})(?:#|\b)[ \t]{{0,4}}[:=]?[ \t]{{0,4}}(?:{value})\b", re.IGNORECASE), score, tuple(dict.fromkeys(n.split()[0] for n in names)))
    for kind, names, value, score in lx.LOOSE_LABELS
]

# --- structures --------------------------------------------------------------------------------------

_PREFIXED = [(p.type, re.compile(rf"\b(?:{'|'.join(map(re.escape, p.prefixes))}){p.body}\b", re.IGNORECASE), p.score, tuple(x.lower() for x in p.prefixes)) for p in lx.PREFIXES]
_TOKEN68 = r"[A-Za-z0-9_\-.+/=]"
_KEY_HEAD = re.compile(r"-----BEGIN ((?:[A-Z]{2,9} )?PRIVATE KEY)-----", re.IGNORECASE)
_KEY_BODY = re.compile(r"\bb3BlbnNzaC1rZXktdjE[A-Z0-9+/=]{20,8000}", re.IGNORECASE)
_WEB_TOKEN = re.compile(r"\beyJ[A-Z0-9_\-]{10,4000}\.[A-Z0-9_\-]{10,4000}\.[A-Z0-9_\-]{10,2000}\b", re.IGNORECASE)
_BEARER = re.compile(rf"\bbearer[ \t]{{1,4}}{_TOKEN68}{{16,1024}}", re.IGNORECASE)
_BASIC = re.compile(r"\bbasic[ \t]{1,4}[A-Z0-9+/]{16,512}={0,2}", re.IGNORECASE)
_AUTHORIZATION = re.compile(rf"\bauthorization[ \t]{{0,4}}:[ \t]{{0,4}}(?:(?:bearer|basic|token|digest)[ \t]{{0,2}})?{_TOKEN68}{{8,1024}}", re.IGNORECASE)
_SET_COOKIE = re.compile(rf"\bset-cookie[ \t]{{0,4}}:[ \t]{{0,4}}{_TOKEN68}{{4,128}}=[^;\s]{{4,512}}", re.IGNORECASE)
_USER_INFO = re.compile(r"(?:\b(?P<scheme>[a-z][a-z0-9+]{1,15}+):)?(?P<rest>//[^:/\s]{1,64}:(?P<pw>[^@/\s]{1,128}))@(?P<host>[^\s/]{1,255})?", re.IGNORECASE)
_ODBC = re.compile(r"\b(?:server|data source)[ \t]{0,4}=[^;]{1,128};[^;]{0,256}?\b(?:password|pwd)[ \t]{0,4}=[^;\s]{1,128}", re.IGNORECASE)
_KEY_ID = re.compile(r'"private_key_id"[ \t]{0,4}:[ \t]{0,4}"[a-f0-9]{40}"', re.IGNORECASE)
_TRACK_1 = re.compile(r"%B\d{12,19}\^[A-Z /.]{2,26}\^\d{4}[0-9A-Z ?]{0,60}\?", re.IGNORECASE)
_TRACK_2 = re.compile(r";\d{12,19}=\d{4}[0-9]{0,50}\?")
_SAID = re.compile(r'"role"[ \t]{0,4}:[ \t]{0,4}"(\w{1,16})"[ \t]{0,4},[ \t]{0,4}"content"[ \t]{0,4}:[ \t]{0,4}"[^"\'\n]{16,2000}"', re.IGNORECASE)
#: Structures that are one pattern: type, pattern, score, one of which every match holds in lower case.
_SHAPES = (
    ("JWT", _WEB_TOKEN, 0.9, ("eyj",)), ("ACCESS_TOKEN", _BEARER, 0.75, ("bearer",)), ("AUTHORIZATION_HEADER", _BASIC, 0.75, ("basic",)), ("AUTHORIZATION_HEADER", _AUTHORIZATION, 0.8, ("authorization",)),
    ("SESSION_COOKIE", _SET_COOKIE, 0.6, ("set-cookie",)), ("CONNECTION_STRING", _ODBC, 0.85, ("password", "pwd")), ("CLOUD_CREDENTIAL", _KEY_ID, 0.85, ("private_key_id",)), ("SSH_PRIVATE_KEY", _KEY_BODY, 0.85, ("b3blbnnzac1rzxktdje",)),
    ("TRACK_DATA", _TRACK_1, 0.9, ("%b",)), ("TRACK_DATA", _TRACK_2, 0.9, (";",)),
    *((kind, pattern, score, cues) for kind, pattern, score, cues in (*_PREFIXED, *_LOOSE)),
)
_GENERIC = tuple((kind, re.compile(pattern), score, (cue,) if cue else ()) for kind, pattern, score, cue in lx.GENERIC)


def _key_blocks(text: str) -> Iterator[Hit]:
    """Private key blocks to their end mark; a head without one stands for itself."""
    for m in _KEY_HEAD.finditer(text):
        at = text.find("-----END ", m.end(), m.end() + lx.MAX_KEY_BLOCK + 9)
        end = text.find("PRIVATE KEY-----", at, at + 40) if at >= 0 else -1
        if end < 0:
            yield "PRIVATE_KEY", m.start(), m.end(), 0.8
            continue
        yield "PRIVATE_KEY", m.start(), end + 16, 0.95
        if m[1].upper().startswith("OPENSSH"):
            yield "SSH_PRIVATE_KEY", m.start(), end + 16, 0.95


def _addresses(text: str) -> Iterator[Hit]:
    """Passwords in addresses, and the addresses of data services as a whole."""
    for m in _USER_INFO.finditer(text):
        if len(m["pw"]) >= 3:
            yield "PASSWORD", m.start("rest"), m.end("rest"), 0.75
        if m["scheme"] and m["host"] and m["scheme"].lower() in lx.DATA_SCHEMES:
            yield "CONNECTION_STRING", m.start(), m.end(), 0.9


def _said(text: str) -> Iterator[Hit]:
    for m in _SAID.finditer(text):
        if known := lx.SPEAKERS.get(m[1].lower()):
            yield known[0], m.start(), m.end(), known[1]


_SCANNERS: tuple[tuple[frozenset[str], tuple[str, ...], Callable[[str], Iterator[Hit]]], ...] = (
    (frozenset(x.type for x in lx.LABELS), (":", "="), _labelled),
    (frozenset({"PRIVATE_KEY", "SSH_PRIVATE_KEY"}), ("-----begin",), _key_blocks),
    (frozenset({"PASSWORD", "CONNECTION_STRING"}), ("//",), _addresses),
    (frozenset(t for t, _ in lx.SPEAKERS.values()), ('"role"',), _said),
)


def hits(text: str, only: frozenset[str] | None = None, cued: bool = True) -> Iterator[Hit]:
    """All matches of all rules. ``cued`` skips rules of which the text lacks what each of their matches
    holds; it changes no result (the tests run both)."""
    low = text.lower() if cued else ""
    for types, cues, scan in _SCANNERS:
        if (only is None or types & only) and (not cued or any(c in low for c in cues)):
            for hit in scan(text):
                if only is None or hit[0] in only:
                    yield hit
    for kind, pattern, score, cues in (*_SHAPES, *_GENERIC):
        if (only is None or kind in only) and (not cued or not cues or any(c in low for c in cues)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end(), score


_TOKEN = re.compile(r"\S+")

#: A named-entity detector: text to (type, start, end). None is registered by default.
Ner = Callable[[str], list[tuple[str, int, int]]]


def _window(text: str, start: int) -> str:
    """The token where a match starts and the few before it, in lower case."""
    begin = max(0, start - 200)
    at = start
    while at < len(text) and not text[at].isspace():
        at += 1
    return " ".join(_TOKEN.findall(text[begin:at])[-(lx.CONTEXT_TOKENS + 1) :]).lower()


def _entities(text: str, threshold: float, only: frozenset[str] | None) -> list[Entity]:
    out, seen = [], set()
    for kind, start, end, score in hits(text, only):
        check = VALIDATORS.get(kind)
        verdict = check(text[start:end]) if check else None
        if verdict is False or start == end:
            continue
        got = 1.0 if verdict else score
        if got < 1.0 and any(word in _window(text, start) for word in lx.CONTEXT.get(kind, ())):
            got = min(1.0, round(got + lx.CONTEXT_BOOST, 6))
        if got >= threshold and (kind, start, end, got) not in seen:
            seen.add((kind, start, end, got))
            custom = kind in lx.CUSTOM
            out.append(Entity(kind, start, end, got, text[start:end], "CALIBRATED", ["custom_security" if custom else "presidio"], custom))
    return out


_SPACED_ONLY = frozenset(lx.SPACED_TYPES)


def detect(text: str, threshold: float = 0.0, ner: Ner | None = None, only: frozenset[str] | None = None) -> list[Entity]:
    """All detections of one text, overlaps included; of the types in ``only``, where given."""
    if not text or text.isspace():
        return []
    norm, positions = normalize(text)
    out = _entities(norm, threshold, only)
    if ner:
        out += [Entity(kind, a, b, lx.NER_CONFIDENCE, norm[a:b], "HEURISTIC", ["spacy"]) for kind, a, b in ner(norm) if lx.NER_CONFIDENCE >= threshold]
    joined, back = collapse_spaced(norm)
    if back is not None:
        for e in _entities(joined, threshold, _SPACED_ONLY if only is None else _SPACED_ONLY & only):
            a, b = original_span(back, e.start, e.end, len(norm))
            # only what the joining brought to light
            if b - a != e.end - e.start:
                out.append(replace(e, start=a, end=b))
    for e in out:
        e.start, e.end = original_span(positions, e.start, e.end, len(text))
        e.text = text[e.start : e.end]
    return out


def masked_preview(e: Entity) -> str:
    """A preview that a log may show."""
    if e.severity == "HIGH":
        return f"[{e.type}]"
    return "*" * len(e.text) if len(e.text) <= 4 else e.text[:2] + "*" * (len(e.text) - 4) + e.text[-2:]
