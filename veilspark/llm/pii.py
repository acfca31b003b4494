"""Personal information in free text, by anchor expansion.

The text is folded (full-width forms, look-alikes, odd spaces, invisible characters) with its positions
kept. One Aho-Corasick pass over it finds anchors: at-signs and their evasive spellings, digits, street words,
given names, and cues that announce a name.
From each anchor a deterministic local parser expands to the left and right and validates the
boundaries: an address part by part, a mail address label by label (not the user and host of a
connection string), a telephone by its country's plan, an identity number by its issuer's form, a name
by its parts (particles, initials, hyphens, surname first, capitals).

Types: EMAIL, PHONE, NATIONAL_ID, ADDRESS, PERSON. :func:`scrub` puts ``[TYPE]`` over each span and leaves
every other character.

Defined results: NULL stays NULL, empty stays empty, repeated rows give each case once; texts are
scanned whole. A span inside another is dropped. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.folding import fold
from veilspark.session import cut

_U, _L = "A-ZÀ-ÖØ-ÞŁŚŻČŠŽ", "a-zß-öø-ÿāăąćčďđęěğłńňőřśşšťůűźżž"
_WORD = rf"[{_U}][{_L}]+(?:['’][{_U}]?[{_L}]+)?"
_PREFIX = rf"(?:(?:al|el|ben|bin)-|[OD]['’]|Mc|Mac(?=[{_U}])|d['’])"
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|zu|de la|de los|de|del|della|di|da|dos|du|le|la|ten|ter|bin|ibn) "
_GIVEN = rf"{_WORD}(?:-{_WORD})?"
_SURNAME = rf"(?:{_PARTICLE})?{_PREFIX}?{_WORD}(?:-{_PREFIX}?{_WORD})*"
_CAPS_WORD = rf"(?:{_PREFIX})?[{_U}]{{2,}}(?:['’-][{_U}]{{2,}})*"
NAME = re.compile(
    rf"(?P<given>{_GIVEN})(?P<mid>(?: [{_U}]\.| {_GIVEN}){{0,2}}?) (?P<last>{_SURNAME})(?![\w'’])"
)
_LONGER = re.compile(rf" (?P<w>{_SURNAME})(?![\w'’])")
CAPS_NAME = re.compile(rf"(?P<given>{_CAPS_WORD})(?P<mid>(?: [{_U}]\.| {_CAPS_WORD}){{0,1}}) (?P<last>(?:(?:VAN DER|VAN|VON|DE LA|DE|van der|van|von|de) )?{_CAPS_WORD})(?![\w'’])")
REVERSED = re.compile(rf"(?P<last>{_SURNAME}|{_CAPS_WORD}), (?P<given>{_GIVEN}|{_CAPS_WORD})(?P<mid>(?: [{_U}]\.)?)(?![\w'’])")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|M|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Sir|Dame|Judge)\.? ")

#: Words that make a capitalised pair something else than a person.
NOT_NAMES = frozenset(
    """the this that these those there then thank thanks please see our your their his her its my we you they he she it i an a in on at of for to from by with and or but not no
    note update dear kind best regards part invoice total charge follow deliver write call paste use identity saint san são santa st mount port lake new old north south east west
    clinic hospital school station street road lane avenue drive court way place close square bridge ferry weir harbour harbor farm park house tower hall church abbey mill mills depot
    bank energy foods insurance shipping telecom media rail water timber estates engineering logistics pharma holdings co-operative company group ltd plc llc inc gmbh ag sa sons services society institute university college ministry council committee department office team desk
    train monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    flat apt apartment suite unit level error warning information critical verbose date source description event id none null true false import class public private final void string system java python""".split()
)
CUES = {
    # cue: whether the name that follows must begin right behind it
    "mr ": 0, "mrs ": 0, "ms ": 0, "dr ": 0, "mr. ": 0, "mrs. ": 0, "ms. ": 0, "dr. ": 0, "prof. ": 0, "herr ": 0, "frau ": 0, "mme ": 0, "dear ": 0, "hello ": 0, "hi ": 0,
    "call ": 0, "contactez ": 0, "passed on to ": 0, "contact ": 0, "deliver to ": 0, "i am ": 0, "my name is ": 0, "client ": 0, "holder ": 0, "resident ": 0, "customer ": 0, "patient ": 0, 
    "reviewed by ": 0, "author: ": 0, "author ": 0, "owner ": 0, "owner: ": 0, "maintainer: ": 0, "maintainer ": 0, "ask ": 0, "user: ": 0, "signed by ": 0, "written by ": 0, "approved by ": 0, " by ": 0,
    "attn ": 0, "attn: ": 0, "name: ": 0, "actor: ": 0, 'owner="': 0, "name=\"": 0, "regards,\n": 0, "regards,\r\n": 0, "sincerely,\n": 0, "yours,\n": 0, "grüßen\n": 0, "behalf of ": 0,
}
STREETS = tuple(
    "street road lane avenue drive court place close terrace crescent square boulevard parkway highway st. rd. ave. ln. dr. ct. blvd. st rd ave ln blvd way row hill walk gardens mews quay".split()
)
_STREET_ALT = "|".join(re.escape(s) for s in sorted(STREETS, key=len, reverse=True))
_NUMBERED = re.compile(rf"(?:(?:flat|apt|apartment|unit|suite)\.? \d{{1,4}}[a-z]?,? )?\d{{1,5}}[a-z]?,? (?:[{_U}][\w'’-]*\.? ){{1,3}}(?:{_STREET_ALT})(?![\w])", re.I)
_TOWN = rf"[{_U}][\w'’-]+(?: [{_U}][\w'’-]+){{0,2}}?"
_ADDRESS_TAIL = re.compile(rf"(?:,? (?:apt|apartment|unit|suite|flat|#)\.? ?\d{{1,5}}[a-z]?)?(?:, {_TOWN}(?:,? (?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}))?(?![\w]))?", re.I)
_GERMAN = re.compile(rf"(?<![\w])[{_U}][{_L}]*(?:-[{_U}][{_L}]+)*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|graben|markt) \d{{1,4}}[a-z]?(?:, \d{{5}} {_TOWN}(?![\w]))?")
_FRENCH = re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|square) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?[{_U}][\w'’-]*(?:[ -][{_U}][\w'’-]*){{0,3}}(?:, \d{{5}} {_TOWN}(?:-{_TOWN})*(?![\w]))?", re.I)
_SPANISH = re.compile(rf"(?<![\w])(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/) ?(?:(?:de la|de los|del|de) )?[{_U}][\w'’-]*(?: [{_U}][\w'’-]*){{0,3}},? (?:n\.?º ?)?\d{{1,4}}(?:, \d{{5}} {_TOWN}(?![\w]))?")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_HOST = re.compile(rf"\s?(?P<host>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}(?P<tld>[A-Za-z]{{2,24}}))(?![A-Za-z0-9])", re.I)
_LOCAL = re.compile(r"(?:[A-Za-z0-9_%+\-]|\.(?=[A-Za-z0-9_%+\-]))+\s?$")
_EVASIVE_AT = re.compile(r"\s?(?:[\[({<]\s?(?:at|ät|arroba)\s?[\])}>]|[\[({]@[\])}])", re.I)

_DIGITS = re.compile(r"(?<![\w])(?:\+|\(|00)?\d[\d ().\-/]{5,26}\d(?:(?:,? ?(?:ext\.?|extension|x|Durchwahl) ?)\d{1,6})?")
_NANP = r"(?:(?:\+|00)?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}|(?:\+|00)1[ .-]?[2-9]\d\d[ .-]?[2-9]\d\d[ .-]?\d{4}"
_UK = r"(?:(?:\+|00)44[ .-]?(?:\(0\)[ .-]?)?|\(?0)(?:20\)?[ .-]?\d{4}[ .-]?\d{4}|1\d{2,3}\)?[ .-]?\d{3}[ .-]?\d{3,4}|7\d{3}[ .-]?\d{3}[ .-]?\d{3})"
_FR = r"(?:(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?[1-9]|0[1-9](?=[ .-]))(?:[ .-]?\d\d){4}"
_DE = r"(?:(?:\+|00)49[ .\-/]?(?:\(0\)[ .-]?)?|0)[1-9]\d{1,3}[ .\-/](?:\d[ .\-/]?){5,9}\d"
_INTL = r"\+[2-9]\d{0,2}[ .\-/]?(?:\(?\d{1,4}\)?[ .\-/]?){2,5}\d{2,4}"
PHONE = re.compile(rf"(?:{_NANP}|{_UK}|{_FR}|{_DE}|{_INTL})(?:,? ?(?:ext\.?|extension|x|Durchwahl) ?\d{{1,6}})?(?![\d])")
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}(?P<s>[- ])(?!00)\d\d(?P=s)(?!0000)\d{4}(?![\w-])")
_SPACED_SSN = re.compile(r"(?<![\w-])(?:\d ){2}\d (?:- )?(?:\d ){1}\d (?:- )?(?:\d ){3}\d(?![\w-])")
_NINO = re.compile(r"(?<![\w])(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]) ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w])")
_DNI = re.compile(r"(?<![\w-])(?:\d{8}|[XYZ]\d{7})-?(?P<l>[A-HJ-NP-TV-Z])(?![\w-])")
_ID_CUE = re.compile(r"(?i)(?:\bssn|social[ _-]?security(?:[ _-]?(?:number|no\.?))?|national[ _-]?(?:id|insurance)(?:[ _-]?(?:number|no\.?))?|identity[ _-]?(?:no\.?|number|card)|\bnin[o]?\b|\bdni\b|\bnie\b|tax[ _-]?id|personal[ _-]?(?:id|number))\W{0,6}(?:is|was|no\.?|number|:|=|#)?\W{0,6}$")
_ID_PATH = re.compile(r"(?i)(?:^|[._\]/-])(?:ssn|social_?security(?:_?(?:number|no))?|national_?id|nino|dni|identity_?(?:no|number)|nin)$")
_NAME_PATH = re.compile(r"(?i)(?:^|[._\]/-])(?:name|full_?name|actor|author|owner|holder|patient|contact_?name|display_?name)$")
_PHONE_PATH = re.compile(r"(?i)(?:^|[._\]/-])(?:phone|mobile|tel|telephone|fax|cell)(?:_?(?:no|number))?$")
_ADDRESS_PATH = re.compile(r"(?i)(?:^|[._\]/-])(?:address|street|addr)$")
_PAYLOAD_LINE = re.compile(r"(?P<path>[\w.\[\]@-]{1,200}): (?P<v>.*)")

Span = tuple[int, int, str]


class Finder:
    """The anchors with a lexicon of given names and towns."""

    def __init__(self, given: Iterable[str] = (), towns: Iterable[str] = ()) -> None:
        self.given = frozenset(fold(g)[0].lower() for g in given if g)
        self.towns = frozenset(fold(t)[0].lower() for t in towns if t)
        words: dict[str, str] = {w: "S" for w in (f" {s}" for s in STREETS)}
        words |= {w: "G" for w in ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ufer ", "damm ", "ring ", "steig ", "graben ", "markt ")}
        words |= {w: "F" for w in (" rue ", " avenue ", " boulevard ", " place ", " chemin ", " impasse ", " allée ", " quai ", " cours ")}
        words |= {w: "E" for w in ("calle ", "avenida ", "avda. ", "plaza ", "paseo ", "c/ ")}
        # all beginnings of _EVASIVE_AT, and the sign itself
        words |= {"@": "@", **{f"{b}@": "@" for b in "[({"}, **{f"{b}{gap}{at}": "@" for b in "[({<" for gap in ("", " ", "\t", "\n") for at in ("at", "ät", "arroba")}}
        words |= {d: "D" for d in "0123456789"}
        words |= {w: "C" for w in CUES}
        words |= {g: "N" for g in self.given}
        self.automaton = ahocorasick.Automaton()
        for w, kind in words.items():
            old = self.automaton.get(w, ("", 0))[0]
            self.automaton.add_word(w, (old + kind, len(w)))
        self.automaton.make_automaton()

    # -- local parsers ---------------------------------------------------------------------------

    @staticmethod
    def _email(t: str, a: int, b: int) -> Span | None:
        if t[a] != "@":
            m = _EVASIVE_AT.match(t, a)
            if not m:
                return None
            b = m.end()
        local = _LOCAL.search(t, max(0, a - 80), a)
        if not local or not local[0].strip():
            return None
        host = _HOST.match(t, b)
        if not host or (t[a] == "@" and t[b : b + 1] == " "):
            return None
        start = local.start()
        # the user and host of a connection string: a scheme before, with no blank between
        if start and t[start - 1] in ":/" and "://" in t[max(0, start - 300) : start].rsplit(None, 1)[-1].rsplit('"', 1)[-1]:
            return None
        return start, host.end(), "EMAIL"

    @staticmethod
    def _numbered(t: str, at: int) -> Span | None:
        low = max(t.rfind("\n", 0, at) + 1, at - 70)
        for m in re.finditer(r"(?<![\w.,/$-])(?:(?:flat|apt|apartment|unit|suite)\.? \d{1,4}[a-z]?,? )?\d{1,5}[a-z]? ", t[low : at + 1], re.I):
            got = _NUMBERED.match(t, low + m.start())
            if got and got.end() >= at + 2:
                return got.start(), _ADDRESS_TAIL.match(t, got.end()).end(), "ADDRESS"
        return None

    def _known(self, token: str) -> bool:
        return any(p.lower() in self.given for p in token.split("-"))

    def _wrong(self, *tokens: str) -> bool:
        return any(x.lower() in NOT_NAMES for t in tokens for x in (t, *t.split()))

    def _name_at(self, t: str, at: int, cued: bool) -> Span | None:
        """A full name that begins at ``at``; without a cue its given name must be known."""
        m = REVERSED.match(t, at)
        if m and not self._wrong(m["last"], m["given"]) and (self._known(m["given"]) or cued) and m["last"].lower() not in self.towns:
            if not (NAME.match(t, m.start("given")) and self._known(m["given"]) and not cued and not m["mid"]):
                return at, m.end(), "PERSON"
        m = NAME.match(t, at)
        if m:
            if self._wrong(m["given"], m["last"]) or not (cued or self._known(m["given"])) or m["given"].lower() in self.towns:
                return None
            end = m.end()
            for _ in range(2 - m["mid"].count(" ")):
                # a further capitalised word with no mark between: what was taken for the surname was a middle name
                more = _LONGER.match(t, end)
                if not more or self._wrong(more["w"]):
                    break
                end = more.end()
            tail = re.match(rf"[ -]([{_U}][\w-]+)", t[end : end + 30])
            if tail and tail[1].lower() in NOT_NAMES and tail[1].lower() not in ("the", "please", "see", "our", "thank"):
                return None
            return at, end, "PERSON"
        m = CAPS_NAME.match(t, at)
        if m and not self._wrong(m["given"], m["last"]) and (cued or self._known(m["given"])):
            return at, m.end(), "PERSON"
        return None

    # -- a whole text ----------------------------------------------------------------------------

    def spans(self, text: str, path: str = "") -> list[Span]:
        """(start, end, type) in code points of the stored text, in order and disjoint."""
        t, positions = fold(text)
        found: list[Span] = []
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        done_name = done_address = done_mail = done_run = -1
        digit = -2
        named = bool(_ID_PATH.search(path))
        for last, (kinds, n) in self.automaton.iter(low):
            if kinds == "D":
                if last != digit + 1:  # the first digit of a run
                    self._identity(t, last, named, found)
                    if last >= done_run:
                        done_run = self._number(t, last, named, found)
                digit = last
                continue
            a, b = last - n + 1, last + 1
            for kind in kinds:
                if kind == "@":
                    got = self._email(t, a, b) if a > done_mail else None
                    if got:
                        found.append(got)
                        done_mail = got[1]
                elif kind == "N":
                    if a < done_name or not t[a].isupper() or (a and (t[a - 1].isalnum() or t[a - 1] in "'’_@.")) or (b < len(t) and (t[b].isalnum() or t[b] in "_@")):
                        continue
                    got = self._around(t, a)
                    if got and got[0] >= done_name - 1:
                        found.append(got)
                        done_name = got[1]
                elif kind == "C":
                    if a < done_name or (a and t[a - 1].isalnum() and n and not low[a].isspace()):
                        continue
                    title = _TITLE.match(t, b)
                    got = self._name_at(t, title.end() if title else b, True)
                    if got:
                        found.append(got)
                        done_name = got[1]
                elif kind == "S":
                    if a < done_address or (b < len(t) and t[b].isalnum()):
                        continue
                    got = self._numbered(t, a)
                    if got:
                        found.append(got)
                        done_address = got[1]
                elif a >= done_address:
                    pattern = {"G": _GERMAN, "F": _FRENCH, "E": _SPANISH}[kind]
                    m = pattern.search(t, max(0, a - 40, t.rfind("\n", 0, a) + 1), min(len(t), b + 90))
                    if m and m.start() <= last and m.end() >= b:
                        found.append((m.start(), m.end(), "ADDRESS"))
                        done_address = m.end()
        self._path(t, path, found)
        if "\n" in t or ": " in t:
            if _PAYLOAD_HEAD.match(t) or _PAYLOAD_HEAD.search(t):
                at = 0
                for line in t.split("\n"):
                    if m := _PAYLOAD_LINE.fullmatch(line.rstrip("\r")):
                        part: list[Span] = []
                        self._path(m["v"], m["path"], part)
                        found += [(at + m.start("v") + x, at + m.start("v") + y, kind) for x, y, kind in part]
                    at += len(line) + 1
        return _disjoint(found, positions)

    def _around(self, t: str, a: int) -> Span | None:
        """A known given name at ``a``: surname first before it, or a name from it on."""
        line = max(t.rfind("\n", 0, a) + 1, a - 60)
        before = t[line:a]
        if before.endswith(", "):
            m = re.search(rf"(?<![\w'’.-])(?:{_SURNAME}|{_CAPS_WORD}), $", before)
            got = m and self._name_at(t, line + m.start(), False)
            if got and got[1] > a:
                return got
        start = a
        # a hyphenated or double given name may begin before the known part
        if m := re.search(rf"(?<![\w'’.-])({_WORD}-|{_WORD} )$", before):
            if m[1].endswith("-"):
                start = line + m.start()
            elif m[1].strip().lower() in ("saint", "san", "santa", "são", "st"):
                return None
        return self._name_at(t, start, False)

    @staticmethod
    def _number(t: str, at: int, named: bool, found: list[Span]) -> int:
        """A telephone or identity number whose first digit is at ``at``; returns where the next may begin."""
        m = None
        if at and t[at - 1] in "+(":
            m = _DIGITS.match(t, at - 1)
        m = m or _DIGITS.match(t, at)
        if not m:
            return at + 1
        a, run = m.start(), m[0]
        if a and t[a - 1] in ".-/#$€£@" or (a > 1 and t[a - 1] == "-"):
            return m.end()
        got = PHONE.match(t, a)
        if not got and run[0] == "(":  # the bracket is the text's, not the number's
            a, run = a + 1, run[1:]
            got = PHONE.match(t, a)
        digits = sum(c.isdigit() for c in got[0]) if got else 0
        if got and digits >= 9 and not re.match(r"[ .-]?\d|[\w]", t[got.end() : got.end() + 2]):
            found.append((a, got.end(), "PHONE"))
            return m.end()
        first = a + (run[0] in "(+")
        if got := _SSN.match(t, first):
            found.append((first, got.end(), "NATIONAL_ID"))
        elif re.fullmatch(r"\d{9}", run.strip()) and (named or _ID_CUE.search(t, max(0, a - 50), a) or _line_names_id(t, a)):
            found.append((a, a + 9, "NATIONAL_ID"))
        return m.end()

    @staticmethod
    def _identity(t: str, at: int, named: bool, found: list[Span]) -> None:
        """An identity number of letters and digits around the first digit of a run, or of single digits."""
        for start in (at - 2, at - 3):
            if start >= 0 and (m := _NINO.match(t, start)):
                found.append((m.start(), m.end(), "NATIONAL_ID"))
        for start in (at, at - 1):
            if start >= 0 and (m := _DNI.match(t, start)):
                wrong = m[0][:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[0][:8]) % 23] != m["l"]
                if not wrong or named or _ID_CUE.search(t, max(0, m.start() - 50), m.start()):
                    found.append((m.start(), m.end(), "NATIONAL_ID"))
        if m := _SPACED_SSN.match(t, at):
            found.append((m.start(), m.end(), "NATIONAL_ID"))

    @staticmethod
    def _path(v: str, path: str, found: list[Span]) -> None:
        """What a path says about its whole value."""
        if not path or not v.strip():
            return
        if _NAME_PATH.search(path) and (m := NAME_FULL.match(v) or _LOWER_NAME.fullmatch(v)):
            found.append((m.start(1), m.end(1), "PERSON"))
        elif _ID_PATH.search(path):
            if m := re.match(r"\s*(\d{9})\s*$", v):
                found.append((m.start(1), m.end(1), "NATIONAL_ID"))
        elif _ADDRESS_PATH.search(path) and any(c.isdigit() for c in v) and len(v.split()) > 2:
            a = len(v) - len(v.lstrip())
            found.append((a, len(v.rstrip()), "ADDRESS"))


NAME_FULL = re.compile(rf"\s*((?:{NAME.pattern.replace('?P<given>', '').replace('?P<mid>', '').replace('?P<last>', '')})|(?:{_SURNAME}|{_CAPS_WORD}), (?:{_GIVEN}|{_CAPS_WORD})(?: [{_U}]\.)?|{_CAPS_WORD}(?: [{_U}]\.| {_CAPS_WORD}){{0,2}} (?:VAN DER )?{_CAPS_WORD})(?:\s|$)")
_LOWER_NAME = re.compile(rf"\s*([{_L}'’-]{{2,}}(?:,? (?:[{_L}]\.|[{_L}'’-]{{2,}})){{1,3}})\s*")
_PAYLOAD_HEAD = re.compile(r"(?m)^[\w\[\]-]{1,60}(?:\.[\w\[\]-]{1,60})+: ")


def _line_names_id(t: str, a: int) -> bool:
    """Whether the payload line of ``a`` names an identity number by its path."""
    start = t.rfind("\n", 0, a) + 1
    if a - start > 200:
        return False
    m = re.fullmatch(r"([\w.\[\]@-]{1,200}): ?", t[start:a])
    return bool(m and _ID_PATH.search(m[1]))


def _disjoint(found: list[Span], positions: list[int] | None) -> list[Span]:
    rank = {"EMAIL": 0, "NATIONAL_ID": 1, "PHONE": 2, "ADDRESS": 3, "PERSON": 4}
    out: list[Span] = []
    for a, b, kind in sorted(set(found), key=lambda s: (s[0], rank[s[2]], -s[1])):
        if out and a < out[-1][1]:
            continue
        out.append((a, b, kind))
    if positions is not None:
        out = [(positions[a], positions[b - 1] + 1, kind) for a, b, kind in out]
    return out


@lru_cache(8)
def finder(given: tuple[str, ...], towns: tuple[str, ...]) -> Finder:
    return Finder(given, towns)


def scrub(text: str | None, found: Finder, path: str = "") -> str | None:
    """The text with each span replaced by ``[TYPE]``; all else unchanged."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, kind in found.spans(text, path):
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


#: The lexicon is fixed and small; more given names than this are refused rather than broadcast.
MAX_LEXICON = 200_000


def lexicon(df: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given names and towns of a lexicon table (token, kind)."""
    rows = df.select("token", "kind").where("token is not null").distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} entries")
    return tuple(sorted(r.token for r in rows if r.kind == "given")), tuple(sorted(r.token for r in rows if r.kind == "town"))


#: A name is learned if it stands in this share of all name fields: so there are never more than 1 / SUPPORT of them,
#: whatever the table, and the same text is read alike in a table and in a thousand copies of it.
SUPPORT = 5e-6


def learned(fields: DataFrame, least: int = 3) -> tuple[str, ...]:
    """Given names that stand at least ``least`` times, and in a share SUPPORT, in the name fields of all records.

    A count over the whole table, made in the JVM; of the counts only those with that support reach the driver.
    """
    value = F.trim(F.regexp_replace("value", "[\u00a0\u2007\u202f]", " "))
    first = F.when(value.contains(", "), F.regexp_extract(value, r", (\p{Lu}[\p{L}-]+)", 1)).otherwise(F.regexp_extract(value, r"^(\p{Lu}[\p{L}-]+) \p{L}", 1))
    counts = (
        fields.where("not coalesce(is_key, false)").where(F.col("path").rlike(r"(^|[._\]])name$"))
        .select(F.explode(F.split(first, "-")).alias("n")).select(F.initcap(F.lower("n")).alias("n")).where(F.length("n") > 1)
        .groupBy("n").count()
    )
    counts = cut(counts)
    total = counts.agg(F.sum("count")).first()[0] or 0
    names = counts.where(F.col("count") >= max(least, total * SUPPORT)).select("n").collect()
    return tuple(sorted(r.n for r in names if r.n.lower() not in NOT_NAMES))


def known_names(lexicon_table: DataFrame, fields: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The lexicon's given names with those learned, and its towns."""
    given, towns = lexicon(lexicon_table)
    places = {t.lower() for t in towns}
    return tuple(sorted({*given, *(n for n in learned(fields) if n.lower() not in places)})), towns


def _found(shared) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = finder(*shared.value)
        for batch in batches:
            keys, types, starts = [], [], []
            for key, text, path in zip(*(c.to_pylist() for c in batch.columns)):
                for a, _, kind in look.spans(text, path or ""):
                    keys.append(key)
                    types.append(kind)
                    starts.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(types, pa.string()), pa.array(starts, pa.int32())], names=["row_key", "pii_type", "start_pos"])

    return run


def value_path() -> Column:
    """The path of a field's value; a property name is inspected too, but its path tells nothing about it."""
    return F.when(F.coalesce(F.col("is_key"), F.lit(False)), F.lit("")).otherwise(F.col("path")).alias("path")


def found(content: DataFrame, fields: DataFrame, names: tuple) -> DataFrame:
    """Every case of ``content`` and of the values and property names of ``fields``; replayed rows count once."""
    shared = content.sparkSession.sparkContext.broadcast(names)

    def cases(df: DataFrame, src: str) -> DataFrame:
        df = df.where((F.col("text") != "") & F.col("text").isNotNull())
        out = df.select("row_key", "text", "path").mapInArrow(_found(shared), "row_key bigint, pii_type string, start_pos int")
        return out.distinct().select(F.lit(src).alias("src"), "row_key", "pii_type", "start_pos")

    of_content = content.select(F.col("record_id").alias("row_key"), F.col("content").alias("text"), F.lit("").alias("path"))
    of_fields = fields.select(F.col("field_id").alias("row_key"), F.col("value").alias("text"), value_path())
    return cases(of_content, "content").unionByName(cases(of_fields, "field"))


def scrubbed(df: DataFrame, text: str, names: tuple, path: str | None = None, out: str = "scrubbed") -> DataFrame:
    """Add ``text`` with its personal information replaced by typed placeholders."""

    shared = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        look = finder(*shared.value)
        return pd.Series([scrub(t, look, p or "") for t, p in zip(texts, paths)], dtype=object)

    return df.withColumn(out, run(F.col(text), F.col(path) if path else F.lit("")))
