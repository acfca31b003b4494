"""Log lines of many layouts to entries, by longest-common-subsequence template mining.

Passes over the records, none with a shuffle of any text:

1. *Mining* (:func:`mine`). Every partition tokenises its header candidates (lines that hold a time
   of day, JSON objects on one or several lines, ``key=value`` lines, ``Key: value`` blocks) and
   clusters them: a candidate joins the cluster with the longest common subsequence of tokens if that
   covers at least :data:`TAU` of the longer one. What is common stays constant; what differs becomes
   a variable slot. The partitions' templates are counted and merged by the same rule per bucket of
   leading token kinds; structured entries are templates of keys, bucketed by their set of keys.
2. *Classifying* (:func:`classified`, :func:`key_roles`). A second pass counts the values of every slot
   of the templates' headers over all lines, and the kinds of values of every key. A slot's type follows
   from these counts, its delimiters and its place: times parse as times, levels are words of the level
   set, a component is the word of few distinct values that delimiters set apart. Only the layouts,
   as many as programs have, reach the driver.
3. *Parsing* (:func:`entries`). The layouts are compiled and every line of every record is matched.
   A line that fits a layout begins an entry; the lines up to the next one belong to it.

Defined results: NULL, empty or blank content has no entry. Lines before the first entry belong to
none. A line ends at ``\\n``; a ``\\r`` before it belongs to the line end. Without a year in the entry the
year of ``created_at`` is taken (1970 if that is NULL); a row replayed gives each entry once. Extra
columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import cut

#: Share of the longer sequence that the common subsequence must cover to join a cluster.
TAU = 0.5

LOG_TYPES = ("APPLICATION_LOG", "AWS_CLOUDWATCH", "WINDOWS_EVENT_LOG")

LEVELS = {
    "TRACE": "DEBUG", "VERBOSE": "DEBUG", "DEBUG": "DEBUG", "DBG": "DEBUG", "FINE": "DEBUG", "FINER": "DEBUG", "FINEST": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "INFORMATIONAL": "INFO", "NOTICE": "INFO", "AUDIT": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "WRN": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "FAILURE": "ERROR",
    "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL", "ALERT": "FATAL", "EMERG": "FATAL", "EMERGENCY": "FATAL", "PANIC": "FATAL",
}
SYSLOG = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
LETTERS = {"D": "DEBUG", "V": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
NUMBERS = {10: "DEBUG", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}

COMPONENT_KEYS = {"service", "component", "svc", "logger", "module", "source", "program", "app", "name", "logger_name", "source name", "provider", "provider name", "event source", "file", "caller"}
TIME_KEYS = {"ts", "time", "timestamp", "@timestamp", "date", "datetime", "event_time", "eventtime", "date and time"}
LEVEL_KEYS = {"level", "severity", "lvl", "loglevel", "log.level", "levelname", "entry type"}
MESSAGE_KEYS = {"message", "msg", "description", "text"}

_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
TIMES = {
    "iso": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?: ?Z| ?[+-]\d\d:?\d\d)?",
    "ctime": rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) {_MON} [ \d]\d \d\d:\d\d:\d\d(?:\.\d{{1,9}})? \d{{4}}",
    "dmy": rf"\d{{1,2}}-{_MON}-\d{{4}} \d\d:\d\d:\d\d(?:[.,]\d{{1,9}})?",
    "clf": rf"\d{{1,2}}/{_MON}/\d{{4}}:\d\d:\d\d:\d\d(?: [+-]\d{{4}})?",
    "bsd": rf"{_MON} [ \d]\d \d\d:\d\d:\d\d(?:\.\d{{1,9}})?",
    "glog": r"[DVIWEFC]\d{4} \d\d:\d\d:\d\d\.\d{1,9}",
}
_WORD = r"\w[\w.$/-]*"
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_TOKEN = re.compile(
    "|".join(f"(?P<{k}>{v})" for k, v in TIMES.items())
    + rf"|(?P<pri>^<\d{{1,3}}>)|(?P<uuid>{_UUID})|(?P<num>\d+(?![\w.$/-]))|(?P<word>{_WORD})|(?P<tab>\t)|(?P<sp>[ ]+)|(?P<punct>.)",
    re.S,
)
_CLOCK = re.compile(r"\d\d:\d\d:\d\d")
_KEYVALUE = re.compile(r'([\w.@-]+)=("(?:[^"\\]|\\.)*"|\S*)')
_BLOCK_LINE = re.compile(r"([A-Z][A-Za-z]*(?: [A-Za-z]+){0,2}): ?(.*)")
_JSON_PAIR = re.compile(r'"([^"\\]{1,60})"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|null)')
_TIME_FULL = {k: re.compile(v) for k, v in TIMES.items()}


@lru_cache(4096)
def _day(y: int, m: int, d: int) -> int | None:
    try:
        return date(y, m, d).toordinal() - 719163
    except ValueError:
        return None


def _ms(day: int | None, clock: str, frac: str, offset: str) -> int | None:
    if day is None:
        return None
    h, m, s = int(clock[0:2]), int(clock[3:5]), int(clock[6:8])
    if h > 23 or m > 59 or s > 60:
        return None
    ms = ((day * 24 + h) * 60 + m) * 60_000 + s * 1000 + (int((frac + "000")[:3]) if frac else 0)
    if offset and offset != "Z":
        digits = offset.replace(":", "")
        shift = (int(digits[1:3]) * 60 + int(digits[3:5])) * 60_000
        ms -= shift if digits[0] == "+" else -shift
    return ms


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))? ?(Z|[+-]\d\d:?\d\d)?")
_CTIME = re.compile(r"\w{3} (\w{3}) ([ \d]\d) (\d\d:\d\d:\d\d)(?:\.(\d{1,9}))? (\d{4})")
_DMY = re.compile(r"(\d{1,2})-(\w{3})-(\d{4}) (\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))?")
_CLF = re.compile(r"(\d{1,2})/(\w{3})/(\d{4}):(\d\d:\d\d:\d\d)(?: ([+-]\d{4}))?")
_BSD = re.compile(r"(\w{3}) ([ \d]\d) (\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?")
_GLOG = re.compile(r"\w(\d\d)(\d\d) (\d\d:\d\d:\d\d)\.(\d{1,9})")


def parse_time(text: str, year: int) -> int | None:
    """Epoch milliseconds of a time in any of the known shapes; finer digits are cut off."""
    if m := _ISO.fullmatch(text):
        return _ms(_day(int(m[1]), int(m[2]), int(m[3])), m[4], m[5], m[6])
    if m := _GLOG.fullmatch(text):
        return _ms(_day(year, int(m[1]), int(m[2])), m[3], m[4], "")
    if m := _CTIME.fullmatch(text):
        return _ms(_day(int(m[5]), MONTHS.get(m[1], 0), int(m[2])), m[3], m[4], "")
    if m := _DMY.fullmatch(text):
        return _ms(_day(int(m[3]), MONTHS.get(m[2], 0), int(m[1])), m[4], m[5], "")
    if m := _CLF.fullmatch(text):
        return _ms(_day(int(m[3]), MONTHS.get(m[2], 0), int(m[1])), m[4], "", m[5])
    if m := _BSD.fullmatch(text):
        return _ms(_day(year, MONTHS.get(m[1], 0), int(m[2])), m[3], m[4], "")
    return None


def value_time(value, year: int) -> int | None:
    """As :func:`parse_time`, also for epoch numbers in seconds or milliseconds."""
    if isinstance(value, bool) or value is None:
        return None
    text = str(value).strip()
    if re.fullmatch(r"\d{9,10}(?:\.\d+)?", text):
        whole, _, frac = text.partition(".")
        return int(whole) * 1000 + int((frac + "000")[:3])
    if re.fullmatch(r"\d{12,13}(?:\.\d+)?", text):
        return int(text.partition(".")[0])
    return parse_time(text, year)


def value_level(value) -> str:
    """A level by meaning; numbers run in tens from 20 (DEBUG) to 60 (FATAL); '' if it is none."""
    if isinstance(value, bool) or value is None:
        return ""
    text = str(value).strip()
    if text.isdigit():
        return NUMBERS.get(int(text), "")
    return LEVELS.get(text.upper(), "")


# --- tokens and templates -------------------------------------------------------------------------
# A token is (symbol, text): the symbol is one character, the kind of a typed token or the
# punctuation itself. T time, R priority, U uuid, N number, L level, w word, k t l m words that name a
# component, time, level or message and stand before "=", "_" spaces, "\t" tab. In a template the text
# of a variable slot is None; "*" is a slot of any length.


_SYMBOLS = {"pri": "R", "uuid": "U", "num": "N", "tab": "\t", "sp": "_"}


def _symbol(line: str, m: re.Match) -> tuple[str, str]:
    kind, text = m.lastgroup, m[0]
    if kind == "word":
        if text.upper() in LEVELS:
            return "L", "L"
        if line[m.end() : m.end() + 1] == "=":
            low = text.lower()
            return ("k" if low in COMPONENT_KEYS else "t" if low in TIME_KEYS else "l" if low in LEVEL_KEYS else "m" if low in MESSAGE_KEYS else "w"), text
        return "w", text
    if kind == "punct":
        return text, text
    return ("T", kind) if kind in TIMES else (_SYMBOLS[kind], "")


def tokenise(line: str) -> list[tuple[str, str]]:
    return [_symbol(line, m) for m in _TOKEN.finditer(line)]


def lcs(a: list, b: list, same) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = table[i], table[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if same(x, b[j]) else (below[j] if below[j] >= row[j + 1] else row[j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if same(a[i], b[j]) and table[i][j] == table[i + 1][j + 1] + 1:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] > table[i][j + 1] or (table[i + 1][j] == table[i][j + 1] and i <= j):
            i += 1  # of equally long ones the one nearest to the diagonal, which keeps headers aligned
        else:
            j += 1
    return pairs


def _same(x, y) -> bool:
    # constants meet only themselves, variable slots anything of their kind, "*" nothing
    return x[0] == y[0] and x[0] != "*" and (x[1] == y[1] or x[1] is None or y[1] is None)


def merge(a: list, b: list) -> list | None:
    """The template of both, or None if their common subsequence is too short."""
    pairs = lcs(a, b, _same)
    if len(pairs) < TAU * max(sum(x[0] != "*" for x in a), sum(x[0] != "*" for x in b)):
        return None
    out: list = []
    i = j = 0
    for pi, pj in [*pairs, (len(a), len(b))]:
        # what differs is a slot: of one token while the kinds agree, else of any length
        while i < pi and j < pj and a[i][0] == b[j][0] != "*":
            out.append((a[i][0], None))
            i, j = i + 1, j + 1
        if (i < pi or j < pj) and (not out or out[-1][0] != "*"):
            out.append(("*", None))
        if pi < len(a):
            x, y = a[pi], b[pj]
            out.append(x if x[1] == y[1] else (x[0], None))
        i, j = pi + 1, pj + 1
    return out


def _bucket(tokens: list) -> str:
    """Templates are compared only within a bucket: the kinds of the leading tokens."""
    return "".join(x[0] for x in tokens[:4])


_RENDER = {"R": r"<\d{1,3}>", "U": _UUID, "N": r"\d+", "w": _WORD, "_": " +", "\t": r"\t", "*": ".*"}


def _render(x) -> str:
    symbol, text = x
    if symbol == "T":
        return TIMES[text] if text else "(?:" + "|".join(TIMES.values()) + ")"
    if symbol == "L":
        return "[A-Za-z]+"
    if symbol in "wktlm" and text is not None:
        return re.escape(text)
    if symbol in "ktlm":
        return _WORD
    return _RENDER.get(symbol) or re.escape(symbol)


#: Tokens of a template that its header may have.
HEADER = 40
#: Distinct values that a task counts of one slot; a slot of more is no component.
DISTINCT = 5000
#: Words that a header may have before its time.
BEFORE_TIME = 1


def header_of(template: list) -> list:
    """The leading tokens that stand in the same place in every line: up to the first slot of any length."""
    end = next((i for i, x in enumerate(template[:HEADER]) if x[0] == "*"), min(len(template), HEADER))
    return template[:end]


def may_be_header(template: list) -> bool:
    """Whether a template can begin an entry: its time stands behind nothing but marks, typed slots and one word."""
    head = header_of(template)
    at = next((i for i, x in enumerate(head) if x[0] == "T"), None)
    return at is not None and head[0][0] not in "_\t" and sum(x[0] == "w" for x in head[:at]) <= BEFORE_TIME and all(x[0] != "*" for x in head[:at])


def _words(head: list) -> list[int]:
    return [i for i, x in enumerate(head) if x[0] == "w"]


def probe(template: list) -> re.Pattern:
    """A pattern of the header with a group for every word in it, to count their values."""
    head = header_of(template)
    return re.compile("".join(f"(?P<w{i}>{_WORD})" if x[0] == "w" and not _announces(head, i) else _render(x) for i, x in enumerate(head)))


def _announces(head: list, i: int) -> bool:
    """Whether a word is constant and names what follows: ``pid 7``, ``key=``."""
    after = "".join(x[0] for x in head[i + 1 : i + 3])
    return head[i][1] is not None and (after[:1] == "=" or after == "_N" and i > 0 and head[i - 1][0] == "[")


#: What the delimiters of a slot are worth: pattern of the token kinds before it, of those after it, points.
_FRAMES = [
    (re.compile(before), re.compile(after), points)
    for before, after, points in (
        (r"k=$", r"", 6.0),  # a key that names a component
        (r"", r"\[N\]:", 4.0),  # a process number and a colon
        (r"", r":(?:_|$|\*)", 3.0),
        (r"", r":N[\]:_]", 3.5),  # a source file and its line
        (r"", r":[TL]", 2.5),
        (r"[\[(<{]$", r"[\])>}]", 2.0),
        (r"", r"_-(?:_|$)", 2.0),
        (r"\|_?$", r"_?\|", 1.5),
        (r"\t$", r"\t", 1.0),
        (r",\"?$", r"\"?,", 1.0),
        (r"", r"_N(?:_|$)", 1.0),  # a process number after a blank
        (r"L\]?[_\t]$", r"", 0.8),  # next to the level
        (r"", r"_\[?L", 0.8),
    )
]
#: A priority and a version begin the columns host, program, process, message id (a public standard).
_COLUMNS = re.compile(r"RN_T_(?:[wN-]|w)_(?P<c>w)_")


class SlotStats:
    """Of one slot: occurrences, distinct values (None: beyond counting), shares of dotted names and of trailing numbers."""

    def __init__(self, n: int = 0, distinct: int | None = 0, dotted: float = 0.0, numbered: float = 0.0) -> None:
        self.n, self.distinct, self.dotted, self.numbered = n, distinct, dotted, numbered


def component_slot(head: list, stats: dict[int, SlotStats]) -> int | None:
    """The token of a header that names the component, by delimiters, value statistics and place; None if none does."""
    kinds = "".join(x[0] for x in head)
    if m := _COLUMNS.match(kinds):
        return m.start("c")
    best, score = None, 0.0
    for i in _words(head):
        if _announces(head, i):
            continue
        got = sum(points for before, after, points in _FRAMES if before.search(kinds[:i]) and after.match(kinds[i + 1 :]))
        s = stats.get(i, SlotStats())
        if s.n:
            # names of programs come again and again; words of a message do not
            few = s.distinct is not None and s.distinct <= 1 + 1.5 * s.n**0.5
            got += (0.5 if few else -3.0) + 1.5 * s.dotted - 1.5 * s.numbered
        if got > score:
            best, score = i, got
    return best


def layout_of(template: list, stats: dict[int, SlotStats] | None = None) -> dict | None:
    """The layout of a template: a pattern of its header with the slots named; None if it begins no entry."""
    if not may_be_header(template):
        return None
    head = header_of(template)
    kinds = "".join(x[0] for x in head)
    time, part = kinds.index("T"), component_slot(head, stats or {})
    base = max(time, part if part is not None else 0)
    level = _level_slot(kinds, time, part, base)
    stated = level is not None or "R" in kinds[:time] or head[time][1] in (None, "glog")
    framed = part is not None and any(before.search(kinds[:part]) and after.match(kinds[part + 1 :]) for before, after, points in _FRAMES if points >= 2)
    if not (stated or framed) or (part is not None and part < time and not (framed or level is not None)):
        return None
    end = _header_end(head, kinds, max(base, level if level is not None else 0))
    parts = []
    for i in range(end):
        symbol = kinds[i]
        if i == part:
            parts.append(rf"(?P<c>{_WORD})")
        elif i == time:
            parts.append(f"(?P<t>{_render(head[i])})")
        elif i == level:
            parts.append("(?P<l>[A-Za-z]+)")
        elif symbol == "R":
            parts.append(r"<(?P<r>\d{1,3})>")
        elif symbol == "w" and not _announces(head, i):
            parts.append(_WORD)
        elif symbol in "_\t" and i == end - 1 and i > base:
            parts.append(f"(?:{_render(head[i])}|$)")  # the last delimiter may be cut by the line's end
        else:
            parts.append(_render(head[i]))
    return {"kind": "line", "bucket": _bucket(template), "tokens": end, "pattern": "".join(parts)}


def _level_slot(kinds: str, time: int, part: int | None, base: int) -> int | None:
    """The level: a word of the level set before the header's last slot, or right behind it with no colon and blank between."""
    for i, k in enumerate(kinds):
        if k == "L" and (i < base or re.fullmatch(r"[\])>}_\t|,;:\[(<{\"-]{1,5}", kinds[base + 1 : i]) and ":_" not in kinds[base + 1 : i]):
            return i
    return None


def _header_end(head: list, kinds: str, last: int) -> int:
    """Where the message begins: behind the last slot, its delimiters, and further typed groups or columns."""
    end = last + 1
    m = re.match(r"(?:\[N\])?(?::N)?[\])>}\"]*[:;]?", kinds[end:])
    end += m.end()
    delimiter = kinds[end : end + 1]
    if delimiter in (",", "\t") and kinds[end:]:
        # columns of one token each; the last one is the message
        while m := re.match(rf"{delimiter}\"?(?:[wN]|w(?:_w)*)\"?(?={delimiter})", kinds[end:]):
            end += m.end()
        return end + re.match(rf"{delimiter}\"?", kinds[end:]).end()
    while m := re.match(r"_(?:N|-|\[(?:w_N|w|N)(?::w_N)?\])(?=[_:]|$)", kinds[end:]):
        if m[0] == "_-" and kinds[end + 2 : end + 3] != "_":
            break
        end += m.end()
        if m[0] == "_-" and not kinds.startswith("RN"):
            break
    m = re.match(r"(?:_\|)?(?:_|\t)?", kinds[end:])
    return end + m.end()


def _compiled(template: list) -> re.Pattern:
    """What a line must be to belong to a cluster without alignment: its header, or all of it."""
    if may_be_header(template) and len(header_of(template)) >= min(len(template), 6):
        return re.compile("".join(_WORD if x[0] == "w" and x[1] is None else _render(x) for x in header_of(template)), re.S)
    return re.compile("".join(map(_render, template)) + r"\Z", re.S)


def _value_kind(v) -> str:
    if isinstance(v, (dict, list)):
        return "o"
    if isinstance(v, str) and len(v) > 40:
        return "w"
    return "T" if value_time(v, 2000) is not None else "L" if value_level(v) else "N" if isinstance(v, (int, float)) else "w"


# --- units of a record -----------------------------------------------------------------------------


def split_lines(content: str) -> list[str]:
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def _json_unit(lines: list[str], i: int) -> tuple[dict, int] | None:
    """The JSON object that begins at line i and the number of its lines."""
    line = lines[i]
    if line.rstrip().endswith("}") and len(line) > 2:
        end = i + 1
    else:
        if len(line.rstrip()) > 1:
            return None
        end = next((j + 1 for j in range(i + 1, len(lines)) if lines[j].startswith(("}", "{"))), len(lines))
    text = "\n".join(lines[i:end])
    try:
        got = json.loads(text)
        return (got, end - i) if isinstance(got, dict) else None
    except ValueError:
        got = {}
        for k, v in _JSON_PAIR.findall(text):
            try:
                got.setdefault(k, json.loads(v, strict=False))
            except ValueError:
                pass
        return (got, end - i) if got else None


def _block_unit(lines: list[str], i: int, first: str) -> tuple[dict, int] | None:
    """The block of ``Key: value`` lines that begins at line i with the key ``first``."""
    got: dict = {}
    for j in range(i, len(lines)):
        m = _BLOCK_LINE.fullmatch(lines[j])
        if not m or m[1] in got or (j == i and m[1] != first):
            return (got, j - i) if got else None
        got[m[1]] = m[2]
        if m[1].lower() in MESSAGE_KEYS:
            return got, j - i + 1
    return got, len(lines) - i


class Miner:
    """The clusters of one partition."""

    def __init__(self) -> None:
        self.lines: dict[str, list] = {}  # bucket -> [template, count, compiled]
        self.blocks: dict[tuple, int] = {}  # (first key, ((key, type), ...)) -> count
        self.keys: dict[tuple[str, str, str], int] = {}  # (kind, key, type of value) -> count
        self.values: dict[tuple[str, str], dict] = {}  # (kind, key) -> value -> count; None: values beyond DISTINCT
        self.recent: list = []

    def known(self, line: str) -> bool:
        """Count a line whose header a cluster already has; it needs no alignment."""
        for n, c in enumerate(self.recent):
            if c[2].match(line):
                c[1] += 1
                if n:
                    self.recent.insert(0, self.recent.pop(n))
                return True
        return False

    def line(self, line: str) -> None:
        tokens = tokenise(line)
        bucket = self.lines.setdefault(_bucket(tokens), [])
        for c in bucket:
            if (merged := merge(c[0], tokens)) is not None:
                c[0], c[1] = merged, c[1] + 1
                c[2] = _compiled(merged)
                return
        c = [tokens, 1, _compiled(tokens)]
        bucket.append(c)
        self.recent.insert(0, c)

    def structure(self, kind: str, keys: dict) -> None:
        """Count the keys of an object, the kinds of their values, and short values."""
        for k, v in keys.items():
            of = _value_kind(v)
            self.keys[kind, k, of] = self.keys.get((kind, k, of), 0) + 1
            if of == "w" and isinstance(v, str) and len(v) <= 64:
                seen = self.values.setdefault((kind, k), {})
                v = v if v in seen or len(seen) < DISTINCT else None
                seen[v] = seen.get(v, 0) + 1

    def record(self, content: str) -> None:
        lines = split_lines(content)
        i = 0
        while i < len(lines):
            line = lines[i]
            if line.startswith("{") and (unit := _json_unit(lines, i)):
                self.structure("json", unit[0])
                i += unit[1]
                continue
            if _CLOCK.search(line) and not self.known(line):
                m = _BLOCK_LINE.fullmatch(line)
                if m and value_time(m[2], 2000) is not None:
                    self._block(lines, i)
                elif _KEYVALUE.match(line):
                    self.structure("pairs", {k: v.strip('"') for k, v in _KEYVALUE.findall(line)})
                elif any(p.search(line) for p in _TIME_FULL.values()):
                    self.line(line)
            i += 1

    def _block(self, lines: list[str], at: int) -> None:
        """Expand a ``Key: time`` line to the block around it."""
        start, keys = at, {}
        while start > 0 and (m := _BLOCK_LINE.fullmatch(lines[start - 1])) and m[1].lower() not in MESSAGE_KEYS:
            start -= 1
        for j in range(start, len(lines)):
            m = _BLOCK_LINE.fullmatch(lines[j])
            if not m or m[1] in keys:
                break
            keys[m[1]] = m[2]
            if m[1].lower() in MESSAGE_KEYS:
                break
        key = (next(iter(keys)), tuple((k, _value_kind(v)) for k, v in keys.items()))
        self.blocks[key] = self.blocks.get(key, 0) + 1

    def size(self) -> int:
        return len(self.blocks) + len(self.keys) + sum(map(len, self.values.values())) + len(self.recent)

    def rows(self) -> list[tuple[str, str, str, int]]:
        """(kind, bucket, template, count) of all clusters, blocks, keys and values."""
        out = [("line", bucket, json.dumps(c[0]), c[1]) for bucket, clusters in self.lines.items() for c in clusters]
        # blocks meet by the key of their time: what stands before or after it may be another entry's tail
        out += [("block", next((k for k, of in keys if of == "T"), ""), json.dumps([first, keys]), n) for (first, keys), n in self.blocks.items()]
        out += [(f"key {kind}", k, of, n) for (kind, k, of), n in self.keys.items()]
        return out + [(f"value {kind}", k, v, n) for (kind, k), seen in self.values.items() for v, n in seen.items()]


_MINED = "kind string, bucket string, template string, n bigint"
_MINED_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.string()), ("template", pa.string()), ("n", pa.int64())])
#: Clusters, keys and values that a task holds before it hands them on; they are summed up afterwards.
HELD = 200_000


def _mine_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    miner = Miner()
    for batch in batches:
        for content in batch.column(0).to_pylist():
            if content:
                miner.record(content)
        if miner.size() > HELD:
            yield pa.RecordBatch.from_pylist([dict(zip(_MINED_ARROW.names, r)) for r in miner.rows()], schema=_MINED_ARROW)
            miner = Miner()
    yield pa.RecordBatch.from_pylist([dict(zip(_MINED_ARROW.names, r)) for r in miner.rows()], schema=_MINED_ARROW)


def merge_templates(rows: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Merge one bucket's templates (kind, template, count), the commonest first."""
    lines: list[list] = []
    blocks: list[list] = []
    for kind, text, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        got = json.loads(text)
        if kind == "line":
            new = [tuple(x) for x in got]
            for c in lines:
                if (merged := merge(c[0], new)) is not None:
                    c[0], c[1] = merged, c[1] + n
                    break
            else:
                lines.append([new, n])
        else:
            # the constant keys: the common subsequence of the blocks' keys
            keys = [tuple(x) for x in got[1]]
            for c in blocks:
                pairs = lcs(c[0], keys, lambda x, y: x[0] == y[0])
                if len(pairs) >= TAU * max(len(c[0]), len(keys)):
                    c[0], c[1] = [c[0][i] for i, _ in pairs], c[1] + n
                    break
            else:
                blocks.append([keys, n])
    return [("line", json.dumps(t), n) for t, n in lines] + [("block", json.dumps([keys[0][0], keys]), n) for keys, n in blocks if keys]


def _merge_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    kind, bucket = key[0].as_py(), key[1].as_py()
    got = merge_templates([(kind, t, n) for t, n in zip(table["template"].to_pylist(), table["n"].to_pylist())])
    return pa.table({"kind": [g[0] for g in got], "bucket": [bucket] * len(got), "template": [g[1] for g in got], "n": pa.array([g[2] for g in got], pa.int64())})


def log_records(df: DataFrame) -> DataFrame:
    """The records of the log source types, apart from case and outer blanks."""
    return df.where(F.upper(F.trim("source_type")).isin(*LOG_TYPES) & F.col("content").isNotNull())


#: Templates that may begin an entry, at most: programs have layouts, data have not. More are refused, not cut.
MAX_TEMPLATES = 50_000
#: Parts of a bucket that are merged side by side, level by level.
MERGE_PARTS = (64, 1)
#: A key whose name tells nothing gets a role from its values if it stands in this share of the objects.
SUPPORT = 1e-4


def mine(records: DataFrame) -> dict:
    """The layouts of all records' entries and the roles of keys, small tables both."""
    mined = cut(records.select("content").mapInArrow(_mine_partition, _MINED).groupBy("kind", "bucket", "template").agg(F.sum("n").alias("n")))
    # a tree: the templates of all tasks meet in parts first, so that what one task merges of a bucket is few
    merged = mined.where("kind in ('line', 'block')")
    for parts in MERGE_PARTS:
        merged = merged.groupBy("kind", "bucket", F.pmod(F.xxhash64("template"), F.lit(parts)).alias("part")).applyInArrow(_merge_group, _MINED)
    possible = merged.mapInArrow(_possible, _MINED).limit(MAX_TEMPLATES + 1).collect()
    if len(possible) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates of entries: these are no logs of programs")
    templates = sorted(((r.kind, r.template, r.n) for r in possible), key=lambda r: (-r[2], r[1]))
    return {"layouts": classified(records, templates), "keys": key_roles(mined)}


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The templates that may begin an entry."""
    for batch in batches:
        keep = [k == "block" or may_be_header([tuple(x) for x in json.loads(t)]) for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def candidates(content: str) -> Iterator[str]:
    """The lines of a record that mining takes as lines with a header."""
    for line in split_lines(content):
        if not line.startswith("{") and _CLOCK.search(line):
            yield line


def slot_values(templates: list[list], texts: Iterable[str]) -> dict[tuple[int, int], dict]:
    """How often every value stands in every word slot of the templates' headers; None: values beyond DISTINCT."""
    table: dict[str, list] = {}
    for n, t in enumerate(templates):
        table.setdefault(_bucket(t), []).append((n, probe(t), _words(header_of(t))))
    out: dict[tuple[int, int], dict] = {}
    for text in texts:
        for line in candidates(text):
            for n, pattern, words in table.get(bucket_of(line), ()):
                if m := pattern.match(line):
                    groups = m.groupdict()
                    for i in words:
                        if (v := groups.get(f"w{i}")) is not None:
                            seen = out.setdefault((n, i), {})
                            v = v if v in seen or len(seen) < DISTINCT else None
                            seen[v] = seen.get(v, 0) + 1
                    break
    return out


def classified(records: DataFrame, templates: list[tuple[str, str, int]]) -> list[dict]:
    """The layouts of templates, their slots classified by the values that stand in them over all lines."""
    lines = [([tuple(x) for x in json.loads(t)], n) for kind, t, n in templates if kind == "line"]
    stats: dict[int, dict[int, SlotStats]] = {}
    if lines:
        shared = records.sparkSession.sparkContext.broadcast([t for t, _ in lines])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = slot_values(shared.value, (c for batch in batches for c in batch.column(0).to_pylist() if c))
            rows = [(t, i, v, n) for (t, i), seen in found.items() for v, n in seen.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["t", "i", "v", "n"])

        counted = records.select("content").mapInArrow(run, "t int, i int, v string, n bigint").groupBy("t", "i", "v").agg(F.sum("n").alias("n"))
        share = lambda pattern: F.sum(F.when(F.col("v").rlike(pattern), F.col("n")).otherwise(0))
        per = counted.groupBy("t", "i").agg(F.sum("n").alias("n"), F.count("v").alias("d"), F.max(F.col("v").isNull()).alias("more"), share(DOTTED).alias("dotted"), share(NUMBERED).alias("numbered"))
        for r in per.collect():  # at most the words of the headers of MAX_TEMPLATES
            stats.setdefault(r.t, {})[r.i] = SlotStats(r.n, None if r.more else r.d, r.dotted / r.n, r.numbered / r.n)
        shared.unpersist()
    return layouts(lines, stats, [json.loads(t) for kind, t, _ in templates if kind == "block"])


#: Names of programs' parts: words joined by dots, dashes, slashes; and names of instances, which end in a number.
DOTTED = r"^[A-Za-z_]\w*(?:[./$_-][A-Za-z]\w*)+$"
NUMBERED = r"[A-Za-z][._-]?[0-9]+$|^[0-9.:]+$"


def layouts(lines: list[tuple[list, int]], stats: dict[int, dict[int, SlotStats]], blocks: list) -> list[dict]:
    """Layouts of line templates, those of more tokens first, and of blocks; templates of one layout become one."""
    out: dict[str, dict] = {}
    order: dict[str, tuple] = {}
    for k, (template, n) in enumerate(lines):
        if layout := layout_of(template, stats.get(k)):
            out[layout["pattern"]] = layout
            order[layout["pattern"]] = (-layout["tokens"], -(n - order.get(layout["pattern"], (0, 0))[1]))
    found = [out[p] for p in sorted(out, key=lambda p: (order[p], p))]
    return found + [{"kind": "block", "first": first, "keys": [k for k, _ in keys]} for first, keys in blocks if any(v == "T" for _, v in keys)]


def key_roles(mined: DataFrame) -> dict[str, dict[str, list[str]]]:
    """Of structured entries the keys of times, levels and components, by name or by the values they have.

    A name of the fixed sets counts whatever its values; of the others those whose values are times, or
    levels, nearly always, and words of few distinct values, dotted names first.
    """
    keys = mined.where("kind like 'key %'").groupBy(F.substring("kind", 5, 9).alias("kind"), F.col("bucket").alias("key")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("template") == of, F.col("n")).otherwise(0)).alias(name) for of, name in (("T", "times"), ("L", "levels"), ("w", "words"))]
    )
    values = mined.where("kind like 'value %'").groupBy(F.substring("kind", 7, 9).alias("kind"), F.col("bucket").alias("key")).agg(
        F.count("template").alias("d"), F.max(F.col("template").isNull()).alias("more"), F.sum(F.when(F.col("template").rlike(DOTTED), F.col("n")).otherwise(0)).alias("dotted")
    )
    total = keys.groupBy("kind").agg(F.max("n").alias("most"))
    # bounded by the support: each object has few keys, and each of these stands in a share of all objects
    rows = keys.join(values, ["kind", "key"], "left").join(total, "kind").where((F.col("n") >= F.col("most") * SUPPORT) & ((F.col("times") >= 0.95 * F.col("n")) | (F.col("levels") >= 0.95 * F.col("n")) | (F.col("words") >= 0.95 * F.col("n"))))
    out: dict[str, dict[str, list[str]]] = {"json": {"t": [], "l": [], "c": []}, "pairs": {"t": [], "l": [], "c": []}}
    parts: dict[str, list] = {"json": [], "pairs": []}
    for r in sorted(rows.collect(), key=lambda r: (-r.n, r.key)):
        if r.times >= 0.95 * r.n:
            out[r.kind]["t"].append(r.key.lower())
        elif r.levels >= 0.95 * r.n:
            out[r.kind]["l"].append(r.key.lower())
        elif r.d and not r.more and r.d <= 1 + 1.5 * r.n**0.5 and r.key.lower() not in MESSAGE_KEYS:
            parts[r.kind].append((-(r.dotted or 0) / r.n, r.d, r.key.lower()))
    for kind, got in parts.items():
        out[kind]["c"] = [k for *_, k in sorted(got)]
    out["present"] = {r.kind: [] for r in total.collect()}
    return out


def bucket_of(line: str) -> str:
    """The bucket of a line, from its leading tokens alone."""
    out, at = "", 0
    while len(out) < 4 and (m := _TOKEN.match(line, at)):
        out += _symbol(line, m)[0]
        at = m.end()
    return out


class Parser:
    """Layouts, compiled, by the kinds of their leading tokens."""

    def __init__(self, found: dict) -> None:
        self.lines: dict[str, list[re.Pattern]] = {}
        for x in found["layouts"]:
            if x["kind"] == "line":
                self.lines.setdefault(x["bucket"], []).append(re.compile(x["pattern"]))
        self.blocks = {x["first"] for x in found["layouts"] if x["kind"] == "block"}
        roles = found["keys"]
        self.roles = roles
        self.json, self.pairs = "json" in roles["present"], "pairs" in roles["present"]
        self.none = {"t": [], "l": [], "c": []}

    def _object(self, got: dict, year: int, kind: str) -> tuple | None:
        ts = part = message = None
        level = ""
        stated = False
        for k, v in got.items():
            low = k.lower()
            if ts is None and low in TIME_KEYS:
                ts = value_time(v, year)
            elif low in LEVEL_KEYS:
                level, stated = level or value_level(v), True
            elif part is None and low in COMPONENT_KEYS and isinstance(v, (str, int)):
                part = str(v)
            elif message is None and low in MESSAGE_KEYS:
                message = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        if ts is None or part is None or not stated:
            # by the roles that the keys' values gave them
            lower = {k.lower(): v for k, v in got.items()}
            roles = self.roles.get(kind, self.none)
            if ts is None:
                ts = next((t for k in roles["t"] if k in lower and (t := value_time(lower[k], year)) is not None), None)
            if not stated and (named := next((k for k in roles["l"] if k in lower), None)):
                level, stated = value_level(lower[named]), True
            if part is None and ts is not None and stated:
                part = next((str(lower[k]) for k in roles["c"] if isinstance(lower.get(k), str)), "")
        return None if ts is None or part is None else (ts, level, part, message or "")

    def _header(self, line: str, year: int) -> tuple | None:
        """Time, level, component and message of a line that a layout fits."""
        for p in self.lines.get(bucket_of(line), ()):
            if not (m := p.match(line)):
                continue
            groups = m.groupdict()
            level, text = groups.get("l"), groups["t"]
            if level is not None and level.upper() not in LEVELS:
                continue
            ts = parse_time(text, year)
            if ts is None:
                continue
            if level is not None:
                level = LEVELS[level.upper()]
            elif groups.get("r") is not None:
                level = SYSLOG[int(groups["r"]) & 7]
            elif text[:1] in LETTERS and text[1:5].isdigit():
                level = LETTERS[text[0]]
            return ts, level or "", groups.get("c") or "", line[m.end() :]
        return None

    def entries(self, content: str, year: int) -> list[tuple]:
        """(line_no, n_lines, ts_ms, level, component, message) of every entry of a record."""
        lines, found, i = split_lines(content), [], 0
        while i < len(lines):
            line, got, used = lines[i], None, 1
            if line.startswith("{"):
                if self.json and (unit := _json_unit(lines, i)):
                    got, used = self._object(unit[0], year, "json"), unit[1]
                    used = used if got else 1
            elif self.blocks and (colon := line.find(":")) > 0 and line[:colon] in self.blocks:
                if unit := _block_unit(lines, i, line[:colon]):
                    got, used = self._object(unit[0], year, "block"), unit[1]
                    used = used if got else 1
            elif _CLOCK.search(line):
                got = self._header(line, year)
            if got is None and self.pairs and "=" in line and _KEYVALUE.match(line):
                got = self._object({k: v[1:-1] if v[:1] == '"' else v for k, v in _KEYVALUE.findall(line)}, year, "pairs")
            if got:
                found.append((i, used, got))
            i += used
        out = []
        for n, (at, used, (ts, level, part, message)) in enumerate(found):
            end = found[n + 1][0] if n + 1 < len(found) else len(lines)
            out.append((at + 1, end - at, ts, level, part, "\n".join([message, *lines[at + used : end]])))
        return out


ENTRY = "record_id bigint, line_no int, n_lines int, ts_ms bigint, level string, component string"


def entries(records: DataFrame, found: dict, message: bool = True) -> DataFrame:
    """Every entry of every record. ``message`` adds all its text after the header."""

    shared = records.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        types = [("record_id", pa.int64()), ("line_no", pa.int32()), ("n_lines", pa.int32()), ("ts_ms", pa.int64()), ("level", pa.string()), ("component", pa.string())] + [("message", pa.string())] * message
        schema = pa.schema(types)
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for rid, content, year in zip(*(c.to_pylist() for c in batch.columns)):
                for e in parser.entries(content or "", year or 1970):
                    for c, v in zip(cols, (rid, *e)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], schema=schema)

    return records.select("record_id", "content", F.year("created_at").alias("year")).mapInArrow(run, ENTRY + ", message string" * message)


def parse_logs(df: DataFrame, message: bool = True) -> DataFrame:
    """The entries of all log records of ``df``; a replayed record's entries come once.

    Mining runs when this is called, parsing when the result is used.
    """
    records = log_records(df)
    out = entries(records, mine(records), message)
    return out.dropDuplicates(["record_id", "line_no"])
