"""Configuration formats to key paths with offsets, in one walk each over a text as it stands.

A text may hold several formats, or one only in parts (a log that quotes a file, a note with three
lines of YAML), so nothing is loaded: every format has a scanner that follows its nesting and yields
``(path, start, end)`` of each literal value, in code points of the text.

* indentation (YAML): ``key:`` lines open a level, deeper lines belong to it; list marks are blanks;
  block scalars (``|``, ``>``) run to the first line that is not deeper; flow scalars may be quoted;
* sections (INI, TOML, properties): a ``[section]`` names the path of the assignments below it;
* braces (JSON, HCL, object literals): strings, names and braces with a stack of keys, on one line or many;
* elements (XML, plist-like): tags with a stack, CDATA included;
* open quotes: triple, back-ticked or plain quotes that close some lines below.

Defined results: malformed nesting only loses parents, never values; the walk is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Value = tuple[tuple[str, ...], int, int]

#: Characters that a quoted literal over several lines may have.
MAX_LITERAL = 16_384
DEPTH = 64

_NAME = r"[\w.$@/\-]{1,80}"
#: Lines that open a level: the key and nothing, or a block mark, behind its colon.
_LEVEL = re.compile(rf"(?m)^(?P<i>[ \t]*(?:- +)*)(?P<q>[\"']?)(?P<key>{_NAME})(?P=q)[ \t]*:[ \t]*(?P<block>[|>][+\-0-9]{{0,2}})?[ \t]*(?:[&!][\w!]+[ \t]*)?(?:#[^\n]*)?\r?$")
_ENTRY = re.compile(rf"(?m)^(?P<i>[ \t]*(?:- +)*)(?P<q>[\"']?)(?P<key>{_NAME})(?P=q)[ \t]*:[ \t]+(?P<v>[^\s|>\[{{&*#][^\n\r]*)")
_SECTION = re.compile(r"(?m)^[ \t]*\[{1,2}[ \t]*([\w.\-\"' :/]{1,120}?)[ \t]*\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?$")
_SETTING = re.compile(rf"(?m)^[ \t]*(?P<key>{_NAME})[ \t]*[=:][ \t]*(?P<v>[^\s=][^\n\r]*)")
_COMMENT = re.compile(r"\s+[#;].*$")


def _width(indent: str) -> int:
    return len(indent.expandtabs(8))


def _scalar(text: str, start: int, end: int) -> tuple[int, int]:
    """A flow scalar without its quotes, comment and trailing comma."""
    quote = text[start]
    if quote in "\"'":
        close = text.find(quote, start + 1, end)
        if close > start:
            return start + 1, close
    found = text[start:end]
    found = _COMMENT.sub("", found).rstrip().rstrip(",")
    return start, start + len(found)


def indented(text: str) -> Iterator[Value]:
    """Values below keys that open a level, block scalars, and the entries of such levels."""
    levels = list(_LEVEL.finditer(text))
    if not levels:
        return
    stack: list[tuple[int, str, int]] = []  # indentation, key, end of its line
    entries = _ENTRY.finditer(text, levels[0].start())
    entry = next(entries, None)

    def parents(indent: int, at: int) -> tuple[str, ...]:
        while stack and (stack[-1][0] >= indent or _left(text, stack[-1][2], at, stack[-1][0])):
            stack.pop()
        return tuple(key for _, key, _ in stack[-DEPTH:])

    for n, level in enumerate(levels):
        indent = _width(level["i"].replace("-", " "))
        path = parents(indent, level.start())
        stack.append((indent, level["key"], level.end()))
        upto = levels[n + 1].start() if n + 1 < len(levels) else len(text)
        if level["block"]:
            own = _width(re.match(r"[ \t]*", level["i"])[0])
            start, end = _block(text, level.end() + 1, own)
            if start < end:
                yield (*path, level["key"]), start, end
            continue
        while entry and entry.start() < level.end():
            entry = next(entries, None)
        while entry and entry.start() < upto and stack:
            path = parents(_width(entry["i"].replace("-", " ")), entry.start())
            if path:
                yield (*path, entry["key"]), *_scalar(text, entry.start("v"), entry.end("v"))
            entry = next(entries, None)


_LINE = re.compile(r"(?m)^([ \t]*)([^\s#][^\n]*)$")


def _left(text: str, after: int, before: int, indent: int) -> bool:
    """Whether a line between two places is no deeper than a level, so that the level has ended."""
    for m in _LINE.finditer(text, min(after + 1, before), before):
        if _width(m[1]) < indent or (_width(m[1]) == indent and not m[2].startswith("- ")):
            return True
    return False


def _block(text: str, at: int, indent: int) -> tuple[int, int]:
    """The lines of a block scalar: from its first to its last character that is no blank."""
    start = end = -1
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        body = line.strip()
        if body:
            lead = len(line) - len(line.lstrip(" \t"))
            if _width(line[:lead]) <= indent:
                break
            if start < 0:
                start = at + lead
            end = at + lead + len(body)
        at = stop + 1
    return (start, end) if start >= 0 else (0, 0)


def sections(text: str) -> Iterator[Value]:
    """The assignments below ``[section]`` lines."""
    heads = list(_SECTION.finditer(text))
    for n, head in enumerate(heads):
        upto = heads[n + 1].start() if n + 1 < len(heads) else len(text)
        path = tuple(p.strip(" \"'") for p in re.split(r"[.:/]", head[1]) if p.strip(" \"'"))
        at = head.end()
        while m := _SETTING.search(text, at, upto):
            yield (*path, m["key"]), *_scalar(text, m.start("v"), m.end("v"))
            at = m.end()


_MARK = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[{}\[\],;]|(?<![\w"\'])[A-Za-z_][\w\-]{0,80}(?=[ \t]*(?:[:=]|\{|"))|[:=]')


def braced(text: str) -> Iterator[Value]:
    """String values within braces, with the keys of the braces around them."""
    stack: list[tuple[str, ...]] = []
    names: list[str] = []  # names since the last mark: a key, or a block's type and labels
    assigned = False
    for m in _MARK.finditer(text):
        token = m[0]
        if token == "{":
            stack.append(tuple(names[-3:]))
            names, assigned = [], False
        elif token == "}":
            if stack:
                stack.pop()
            names, assigned = [], False
        elif token in "[,;]":
            if token in ",;":
                names = []
            assigned = assigned and token == "["
        elif token in ":=":
            assigned = bool(names)
        elif token[0] in "\"'":
            if assigned and len(token) > 2 and stack:
                yield (*(k for keys in stack[-DEPTH:] for k in keys), names[-1]), m.start() + 1, m.end() - 1
                names, assigned = [], False
            else:
                if assigned:
                    names, assigned = [], False
                names.append(token[1:-1])
        else:
            if assigned or (names and "\n" in text[text.rfind(names[-1], 0, m.start()) : m.start()]):
                names, assigned = [], False
            names.append(token)


_TAG = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][\w:.\-]{0,80})(?P<rest>(?:\s[^<>]{0,2000})?)>(?P<v>\s*(?:<!\[CDATA\[(?P<c>(?:(?!\]\]>)[\s\S]){0,16384})\]\]>\s*|[^<]*))")
_KEY_ATTRIBUTE = re.compile(r"\b(?:name|key|id)\s{0,4}=\s{0,4}[\"']([^\"'\n]{1,80})[\"']")


def elements(text: str) -> Iterator[Value]:
    """Texts of elements that hold nothing else, by the path of their tags; an element's name or key counts as one."""
    stack: list[str] = []
    for m in _TAG.finditer(text):
        if m["end"]:
            if m["name"] in stack:
                while stack.pop() != m["name"]:
                    pass
            continue
        if m["rest"].endswith("/"):
            continue
        stack.append(m["name"])
        group = "c" if m["c"] is not None else "v"
        value = m[group]
        if value.strip() and text.startswith(f"</{m['name']}", m.end()):
            lead = len(value) - len(value.lstrip())
            named = _KEY_ATTRIBUTE.search(m["rest"])
            path = (*stack[-DEPTH:], *((named[1],) if named else ()))
            yield path, m.start(group) + lead, m.start(group) + len(value.rstrip())
        del stack[:-DEPTH]


#: What a literal in plain quotes does not hold: a mark right at its beginning, an empty line, an assignment, a call, a subscript.
_NO_LITERAL = re.compile(r"\A[ \t]*[),;\]}]|\n[ \t]*(?:\r?\n|[\w.\-]{1,80}[ \t]*[:=]|[A-Za-z_][\w.]*[(\[])")
_AFTER_LITERAL = re.compile(r"[ \t]*(?:[,;)\]}\r\n#]|\Z)")


def literal(text: str, start: int, closing: str) -> tuple[int, int] | None:
    """A literal that opened before ``start`` and closes on a later line, without the blanks at its ends.

    Plain quotes must close before an empty line and before anything that looks like another assignment.
    """
    close = text.find(closing, start, start + MAX_LITERAL)
    while close > 0 and text[close - 1] == "\\":
        close = text.find(closing, close + 1, start + MAX_LITERAL)
    if close < 0:
        return None
    body = text[start:close]
    if len(closing) == 1 and closing != "`" and (_NO_LITERAL.search(body) or not _AFTER_LITERAL.match(text, close + 1)):
        return None
    lead = len(body) - len(body.lstrip())
    return (start + lead, start + len(body.rstrip())) if body.strip() else None


def values(text: str) -> Iterator[Value]:
    """All values that the formats' nesting gives a path, in no order; a value may come from several scanners."""
    if ":" in text:
        yield from indented(text)
    if "[" in text and ("=" in text or ":" in text):
        yield from sections(text)
    if "{" in text:
        yield from braced(text)
    if "</" in text:
        yield from elements(text)
