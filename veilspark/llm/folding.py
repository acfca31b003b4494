"""Characters that look alike: tables, folding with a position map, scripts of tokens."""

from __future__ import annotations

import re
import unicodedata

#: Invisible characters: they leave no mark in the text.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿️︎"
#: No-break and other spaces that look like the ordinary one.
SPACES = "              　"

# Letters of other scripts and the Latin letters they look like (fixed values).
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌҮёїЁЇ", "aeopcyxijshdqwABEKMHOPCTYXIJSGYëïËÏ", strict=True))
GREEK = dict(zip("οανρϲιυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "oavpciukABEZHIKMNOPTYXC", strict=True))
#: Latin letters of other shapes that most fonts draw like the plain one.
LATIN = dict(zip("ɑɡıʏʀ", "agiyr", strict=True))
LOOKALIKE = {**CYRILLIC, **GREEK, **LATIN}
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}

WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_PLAIN = {**WIDE, **dict.fromkeys(map(ord, SPACES), 32)}
BASE_TABLE = {**_PLAIN, **_DROP}
FULL_TABLE = {**BASE_TABLE, **{ord(k): ord(v) for k, v in LOOKALIKE.items()}}
_MAPPED = re.compile("[" + re.escape(INVISIBLE) + "]|[̀-ͯ]")
_ODD = re.compile("[！-～" + re.escape(SPACES) + "]+")
_ODD_OR_GONE = re.compile("[！-～" + re.escape(SPACES + INVISIBLE) + "]+")
#: A run of letters with the accents that compose with none of them.
WORD = re.compile(r"(?:[^\W\d_]+[\u0300-\u036f]*)+")
_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "]")


def plain(text: str) -> str:
    """Full-width forms, spaces, invisible characters and combining accents in one form; letters stay."""
    if text.isascii():
        return text
    # long texts hold few such characters: a search for runs of them is faster than a table walk
    return unicodedata.normalize("NFC", _ODD_OR_GONE.sub(lambda m: m[0].translate(BASE_TABLE), text))


def skeleton(text: str) -> str:
    """:func:`plain` with every look-alike letter made Latin: equal for all texts that look the same."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", plain(text).translate(FULL_TABLE))


def token_target(token: str) -> str:
    """The script that a token's letters speak for: L, C, G, or '' if all its letters look like others'."""
    latin = cyrillic = greek = 0
    for c in token:
        if c in LOOKALIKE:
            continue
        o = ord(c)
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            # a Latin letter with a twin elsewhere speaks for Latin, but less than one without
            latin += 1 if (c in TO_CYRILLIC or c in TO_GREEK) else 4
        elif 0x400 <= o < 0x530:
            cyrillic += 4
        elif 0x370 <= o < 0x400:
            greek += 4
    if not (latin or cyrillic or greek):
        return ""
    best = max(latin, cyrillic, greek)
    return "L" if latin == best else "C" if cyrillic == best else "G"


def fold(text: str) -> tuple[str, list[int] | None]:
    """Text for detection and, where lengths differ, the original position of every character of it.

    Full-width forms, odd spaces and look-alikes become plain, invisible characters go. Look-alikes stay
    in tokens that speak for their own script.
    """
    if text.isascii():
        return text, None
    positions = None
    if _MAPPED.search(text):
        out, positions = [], []
        for i, c in enumerate(text):
            if c in INVISIBLE:
                continue
            if out and "̀" <= c <= "ͯ":
                one = unicodedata.normalize("NFC", out[-1] + c)
                if len(one) == 1:
                    out[-1] = one
                    continue
            out.append(c)
            positions.append(i)
        text = "".join(out)
    text = _ODD.sub(lambda m: m[0].translate(_PLAIN), text)
    parts, at = [], 0
    for m in _FOREIGN.finditer(text):
        if m.start() < at:
            continue
        a, b = m.span()
        while a > at and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        if token_target(text[a:b]) in ("L", ""):
            parts += [text[at:a], "".join(LOOKALIKE.get(c, c) for c in text[a:b])]
        else:
            parts.append(text[at:b])
        at = b
    return ("".join([*parts, text[at:]]) if parts else text), positions
