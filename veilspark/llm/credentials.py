"""Credentials in source, configuration, payloads, logs and notes: key paths, value shapes, splicing.

A text is folded (full-width forms, look-alikes, invisible characters) with its positions kept, and read
in two ways. Its configuration is parsed to key paths with offsets (:mod:`veilspark.llm.configs`: nested
YAML with block scalars, INI and TOML sections, JSON and other braces, XML elements, literals over several
lines). And lines that hold an anchor (a sensitive word, a scheme, a key's beginning) are parsed as
assignments in code: ``key = value``, ``key: value``, ``index["key"] = value``, ``put("key", "value")``,
``<add key= value=>``, ``setKey("value")``, command-line flags, ``name: key / value: value``. A value is a
credential if the last words of its key path are sensitive (general words like ``value`` aside) and it is a
literal: not empty, a mask, a placeholder, a reference to a variable, file or vault, a call, a number or a
plain word. Besides, shapes speak for themselves: connection strings with a password, signed tokens,
keys of shuffled letters and digits behind a short prefix, bearer and basic headers (basic ones are
decoded), private key blocks.

:func:`redact` splices a placeholder over each value and leaves every other character; quotes, the
scheme and host of a connection string, and the frame of a key block stay, so files remain well-formed.

Defined results: NULL stays NULL, empty stays empty, repeated rows give one case each; a text is
scanned whole, whatever its length. Extra columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import ascii_lowercase

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import configs
from veilspark.llm.folding import fold

LAST = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "pw", "secret", "token", "tok", "jwt", "bearer", "credential", "credentials", "apikey", "secretkey", "accesskey", "privatekey", "psk", "authtoken", "apitoken"}
PAIRS = {("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("account", "key"), ("shared", "key"), ("license", "key")}
#: What a line must hold, in lower case, to be parsed at all: the last word of every sensitive key, and what each pattern below cannot do without.
KEY_WORDS = frozenset({*LAST, *(pair[-1] for pair in PAIRS)})
ANCHORS = (
    *sorted(KEY_WORDS), "basic", "://", "eyj", "akia", "asia", "-----begin", *(f"gh{c}_" for c in ascii_lowercase),
    "sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "xox", "aiza", "curl", "wget", "http", "mysql", "login", "default", "value",
)
#: Last words of a key path that say nothing: what is before them counts.
GENERAL = {"value", "values", "default", "data", "content", "current", "literal", "plain", "plaintext", "string", "text", "raw", "clear"}


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in ANCHORS:
        automaton.add_word(word, word in KEY_WORDS)
    automaton.make_automaton()
    return automaton


_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@lru_cache(65536)
def sensitive(path: str) -> bool:
    """Whether the last words of a key path name a secret."""
    words = [w.lower() for w in _WORDS.findall(path)]
    if not words:
        return False
    last = words[-1]
    if last in LAST or (len(last) > 6 and last.endswith(("password", "passwd", "passphrase", "apikey", "secret"))):
        return True
    return tuple(words[-2:]) in PAIRS or tuple(words[-3:]) == ("access", "key", "id") or words[-2:] == ["key", "base"]


@lru_cache(65536)
def sensitive_path(path: tuple[str, ...]) -> bool:
    """Whether a key path names a secret: its own key does, or it says nothing and the keys above do."""
    if sensitive(path[-1]):
        return True
    words = [w for key in path[-4:] for w in _WORDS.findall(key)]
    own = [w.lower() for w in _WORDS.findall(path[-1])]
    if not own or not (set(own) <= GENERAL or own[-1] == "key"):
        return False
    while words and words[-1].lower() in GENERAL:
        words.pop()
    return bool(words) and sensitive("_".join(words))


_PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
      [*x•.\#_?-]+ | \$\{.* | \$[a-z_]\w* | \$\(.* | %\(.* | %[a-z_]+% | \{.* | <.*>? | \[.* | \(.* | @.*
    | (?:env|secret|secrets|vault|ssm|kms|ref|file|var|param|lookup|op|keyring|arn|sops|data|none|null)[(:].*
    | (?:secret|secrets|vault|ref|data)/[\w/.\#-]* | vault:.* | op://.* | file://.*
    | none | null | nil | true | false | undefined | empty | changeme | change_me | change-me | todo | tbd | unset | redacted | removed | hidden | masked | n/?a | default | example | placeholder | dummy | password | secret | token | required | optional
    | your[_-].* | .*[_-]here | my[_-]?(?:password|secret|token|key) | insert.* | replace.* | enter[_-].* | dummy[_-].* | example[_-].* | test[_-]?(?:key|token|password|secret)
    )$"""
)
_MASKED = re.compile(r"(?i)x{6,}|\*{3,}|•{3,}|\$\{|\{\{|\[REDACTED|<redacted|…")
_REFERENCE = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+\(?;?|(?:process|os|env|var|local|module|self|this|request|response|config|settings|ctx|cfg|System|System\.getenv)\.[\w.\[\]\"']+")
_PATH = re.compile(r"\.{0,2}/[a-z][a-z_./-]*|[A-Za-z]:\\.*")
_PLAIN_WORD = re.compile(r"[a-z]+(?:_[a-z]+)*|[A-Z]?[a-z]{1,12}|[A-Z]+(?:_[A-Z]+)+")


def _shuffled(value: str) -> bool:
    """Whether small and capital letters change as they only do in made-up strings."""
    return len(value) >= 16 and sum(a.islower() and b.isupper() for a, b in zip(value, value[1:])) >= 3


def _made_up(value: str) -> bool:
    """Whether letters of both cases and digits are mixed as no identifier mixes them."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return len(set(kinds)) == 3 and changes >= 0.25 * len(value) or "u" in kinds and "l" in kinds and changes >= 0.4 * len(value)


def secret_value(value: str, quoted: bool = False, least: int = 6) -> bool:
    """Whether a value of a sensitive key is a secret in clear or encoded form."""
    if len(value) < least or _PLACEHOLDER.match(value) or _MASKED.search(value):
        return False
    if value.isdigit() or not any(c.isalnum() for c in value) or _PLAIN_WORD.fullmatch(value):
        return False
    if _PATH.fullmatch(value) or (" " in value and not quoted):
        return False
    if _REFERENCE.fullmatch(value) and not any(c.isdigit() for c in value) and not _shuffled(value):
        return False
    return sum(c.isalnum() for c in value) >= 4


ASSIGN = re.compile(r"""(?<![\w.])(?P<kq>["'`]?)(?P<key>[A-Za-z_@][\w.\-]{0,80}(?:\[\d+\])?(?:[.][\w.\-]{1,80})?(?:[ ](?:[Kk]ey|[Tt]oken|[Ss]ecret|[Pp]assword))?)(?P=kq)\]?[ \t]{0,8}(?::=|=>|=(?!=)|:(?![/:]))[ \t]{0,8}(?P<open>\(?[ \t]{0,4}(?:[rbfuRBFU]{0,2}(?:\"{3}|'{3}|["'`]))?)""")
_BARE = re.compile(r"[^\s,;\"'`()\[\]{}<>]+")
_BARE_ANY = re.compile(r"\S+")
URL = re.compile(r"""(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]{1,30})://(?P<user>[^\s:/?#@"'<>]{0,200}):(?P<pw>[^\s"'`@/][^\s"'`@]{0,300})@(?=[\w\[])""")
CALL = re.compile(r"""\b(?:set|with|use|add)?(?P<key>[A-Za-z]*(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey|[Cc]redential)[A-Za-z]*)\([ \t]{0,4}(?P<q>["'`])(?P<v>[^"'`\n]{1,500})(?P=q)""")
PUT = re.compile(r"""\(\s{0,4}(["'])(?P<key>[A-Za-z][\w.\-]{1,80})\1\s{0,4},\s{0,4}(["'])(?P<v>[^"'\n]{1,500})\3""")
ADD = re.compile(r"""(?i)\b(?:key|name)\s{0,4}=\s{0,4}(["'])(?P<key>[^"'\n]{1,80})\1\s{1,8}value\s{0,4}=\s{0,4}(["'])(?P<v>[^"'\n]{1,500})\3""")
FLAG = re.compile(r"""(?:^|\s)--?(?P<key>[a-z][a-z\-]{0,30}(?:token|password|passwd|secret|key|pass)|token|password|passwd|secret|pass)(?:\s{1,4}|=)["']?(?P<v>[^\s"']+)""")
SHORT = re.compile(r"""\b(?:mysql(?:dump|admin)?\b[^\n|;]*?\s-p|login\b[^\n|;]*?\s-p\s{1,4}|sshpass\s{1,4}-p\s{0,4})["']?(?P<v>[^\s"']+)|\b(?:curl|wget|http)\b[^\n|;]*?\s(?:-u|--user)\s{1,4}["']?[^\s:"']+:(?P<w>[^\s"'@]+)""")
PROSE = re.compile(r"""(?i)\b(?:password|passwd|passphrase|passcode|token|secret|api[ ]key|access[ ]key|pw)\s{1,3}(?:is|was|are|to|reads)\s{1,3}["'“]?(?P<v>[^\s"'”]+)|\bcredentials?\s{1,3}["'“]?(?P<w>[^\s"'”,]+)""")
KEYED = re.compile(r"\b(?P<use>[Uu]se (?:the )?)?[Kk]ey\s{1,3}[\"'“]?(?P<v>[A-Za-z0-9_.+/=\-]{16,})")
BEARER = re.compile(r"(?i)\bbearer\s{1,4}(?P<v>[A-Za-z0-9._~+/=\-]{12,})")
BASIC = re.compile(r"(?i)\bbasic\s{1,4}(?P<v>[A-Za-z0-9+/]{8,}={0,2})")
SHAPE = re.compile(
    r"(?<![A-Za-z0-9_/+=\-.])(?:eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*)?|(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?:gh[a-z]_|xox[abprs]-|AIza)[A-Za-z0-9_\-]{16,}|(?:sk|pk|rk)[_\-](?:live|prod|stage|test|ant)?[_\-]?[A-Za-z0-9]{18,})"
)
#: A short prefix and a run of letters and digits; whether they are shuffled is tested.
_TAGGED = re.compile(r"(?<![A-Za-z0-9_/+=\-.])[a-z]{2,5}[0-9]?[_\-](?:[a-z]{2,5}[_\-])?([A-Za-z0-9]{16,})(?![A-Za-z0-9_\-])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_DEFAULT = re.compile(r"""^\s*default\s*=\s*(["'])(?P<v>[^"'\n]*)\1""")
_VALUE = re.compile(r"""^\s*-?\s*value\s*:\s*(["']?)(?P<v>[^"'\n]*)\1""")
_NAME = re.compile(r"""^\s*-?\s*name\s*:\s*["']?([\w.\-]+)""")
_TAIL = ".,;:)!?"


#: Words that stand for a kind of value or a state rather than for a value.
_KINDS = {"string", "integer", "number", "boolean", "object", "array", "secret", "hidden", "masked", "plain", "plaintext", "encrypted", "hashed", "required", "optional", "enabled", "disabled", "invalid", "missing", "expired", "unknown", "forgotten", "reset", "change", "confirm", "current", "default", "account", "credential", "credentials", "passphrase", "passcode", "authentication", "username"}


def _spelled(key: str, value: str) -> bool:
    """Whether a quoted plain word under a password's key is the password: any word but one that names a kind of value."""
    words = [w.lower() for w in _WORDS.findall(key)]
    if not words or words[-1] not in ("password", "passwd", "pwd", "passphrase", "pass"):
        return False
    return len(value) >= 6 and value.isalpha() and value.isascii() and value.lower() not in _KINDS and not _PLACEHOLDER.match(value) and value.lower() not in words


def _literal_secret(value: str) -> bool:
    """Whether a value of one or more lines is a secret; several lines must be key text, without blanks inside."""
    lines = [x.strip() for x in value.split("\n") if x.strip()]
    if len(lines) == 1:
        return secret_value(lines[0], True)
    return not any(" " in x or "\t" in x for x in lines) and "-----BEGIN" not in value and secret_value("".join(lines), True)


def _configured(text: str) -> Iterator[tuple[int, int, str]]:
    """The credentials that the nesting of a configuration gives a sensitive key path."""
    for path, start, end in configs.values(text):
        if start < end and sensitive_path(path):
            value = text[start:end]
            if "://" not in value and _literal_secret(value) and (value[:7].lower() != "bearer " and value[:6].lower() != "basic "):
                yield start, end, _kind(path[-1] if sensitive(path[-1]) else "_".join(path[-2:]))


def _basic(value: str) -> bool:
    try:
        got = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (ValueError, binascii.Error):
        return False
    user, colon, pw = got.partition(":")
    return bool(colon) and user.isprintable() and pw.isprintable() and secret_value(pw, True, 4)


def _line(s: str, text: str, at: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the credentials that begin on one line of ``text`` at offset ``at``."""
    for m in URL.finditer(s):
        if not _PLACEHOLDER.match(m["pw"]) and not _MASKED.search(m["pw"]) and "}" not in m["user"]:
            yield m.start("pw"), m.end("pw"), "CONNECTION_STRING"
    for m in SHAPE.finditer(s):
        if not _MASKED.search(m[0]):
            yield m.start(), m.end(), "TOKEN"
    for m in BEARER.finditer(s):
        if secret_value(m["v"], least=12) and (any(c.isdigit() for c in m["v"]) or _shuffled(m["v"])):
            yield m.start("v"), m.end("v"), "TOKEN"
    for m in BASIC.finditer(s):
        if _basic(m["v"]):
            yield m.start("v"), m.end("v"), "BASIC_AUTH"
    for m in ASSIGN.finditer(s):
        if not sensitive(m["key"]):
            continue
        opened, start = m["open"].rstrip(), m.end()
        quote = opened[-1:] if opened[-1:] in "\"'`" and opened else ""
        if quote:
            closing = opened[-3:] if opened[-3:] in ('"""', "'''") else quote
            end = s.find(closing, start)
            while end > 0 and s[end - 1] == "\\" and quote != "`":
                end = s.find(closing, end + 1)
            if end < 0:  # the literal closes on another line
                if (more := configs.literal(text, at + start, closing)) and _literal_secret(text[more[0] : more[1]]):
                    yield more[0] - at, more[1] - at, _kind(m["key"])
                    continue
                end = len(s)
            if "-----BEGIN" in s[start:end]:
                continue
            if secret_value(s[start:end], True) or _spelled(m["key"], s[start:end]):
                yield start, end, _kind(m["key"])
            continue
        if opened:  # an opening bracket without a literal is code
            continue
        v = _BARE.match(s, start)
        if not v:
            continue
        end = v.end()
        if s[end : end + 1] == "(" or s[end : end + 1] == "[":
            continue
        value = v[0]
        if cut := re.search(r"&\w+=", value):
            value = value[: cut.start()]
        if value.lower() in ("bearer", "basic") or "://" in value:
            continue
        if secret_value(value):
            yield start, start + len(value), _kind(m["key"])
    for pattern in (CALL, PUT, ADD, FLAG):
        for m in pattern.finditer(s):
            if sensitive(m["key"]) and secret_value(m["v"], pattern is not FLAG):
                yield m.start("v"), m.end("v"), _kind(m["key"])
    for m in SHORT.finditer(s):
        g = "v" if m["v"] else "w"
        if secret_value(m[g]):
            yield m.start(g), m.end(g), "PASSWORD"
    for m in PROSE.finditer(s):
        g = "v" if m["v"] else "w"
        value = m[g].rstrip(_TAIL)
        # words in prose are no secrets: a value has a digit, a joined phrase or mixed letters
        mixed = any(c.isdigit() for c in value) or value.count("-") > 1 or (any(c.isupper() for c in value[1:]) and any(c.islower() for c in value))
        if mixed and secret_value(value) and (g == "v" or len(value) >= 12):
            yield m.start(g), m.start(g) + len(value), "PASSWORD" if g == "v" else "TOKEN"
    for m in KEYED.finditer(s):
        value = m["v"].rstrip(_TAIL)
        if secret_value(value, least=16) and (_shuffled(value) or (any(c.isdigit() for c in value) and (m["use"] or (any(c.isupper() for c in value) and any(c.islower() for c in value))))):
            yield m.start("v"), m.start("v") + len(value), "API_KEY"
    if m := _DEFAULT.match(s):
        opened = text.rfind('variable "', max(0, at - 2000), at)
        if opened >= 0 and "\n}" not in text[opened:at]:
            name = text[opened + 10 : text.find('"', opened + 10)]
            if sensitive(name) and secret_value(m["v"], True):
                yield m.start("v"), m.end("v"), _kind(name)
    if (m := _VALUE.match(s)) and at:
        before = text[text.rfind("\n", 0, at - 1) + 1 : at]
        if (n := _NAME.match(before)) and sensitive(n[1]) and secret_value(m["v"].rstrip(), bool(m[1])):
            yield m.start("v"), m.start("v") + len(m["v"].rstrip()), _kind(n[1])


def _kind(key: str) -> str:
    low = key.lower()
    return "PASSWORD" if "pass" in low or low.endswith(("pwd", "pw")) else "TOKEN" if "tok" in low or low in ("jwt", "bearer") else "API_KEY" if "key" in low else "SECRET"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential, in code points of the stored text, in order, disjoint."""
    folded, positions = fold(text)
    found: list[tuple[int, int, str]] = []
    at, n = 0, len(folded)
    low = folded.lower()
    if len(low) != n:  # the lower case of a few letters is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in folded)
    hits = list(_anchors().iter(low))
    if any(named for _, named in hits):
        found += _configured(folded)
    # keys behind a prefix need no anchor
    found += [(m.start(), m.end(), "TOKEN") for m in _TAGGED.finditer(folded) if _made_up(m[1])]
    for hit, _ in hits:
        if hit < at:
            continue
        start = max(folded.rfind("\n", 0, hit) + 1, at)
        end = folded.find("\n", hit)
        end = n if end < 0 else end
        s = folded[start:end]
        if s.endswith("\r"):
            s = s[:-1]
        p = PEM.search(s)
        if p:
            close = _PEM_END.search(folded, start + p.end())
            begin = start + p.end()
            other = PEM.search(folded, begin)
            if close and not (other and other.start() < close.start()):
                stop = close.start()
            else:  # cut off: the lines of key text that follow
                stop = begin + len(re.match(r"(?:\r?\n[A-Za-z0-9+/=:, \-]+)*", folded[begin:])[0])
            found.append((start + p.start(), max(stop, begin), "PRIVATE_KEY"))
            s = s[: p.start()]
            for a, b, kind in _line(s, folded, start):
                found.append((start + a, start + b, kind))
            at = max(end + 1, stop)
            continue
        for a, b, kind in _line(s, folded, start):
            found.append((start + a, start + b, kind))
        at = end + 1
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            if b > out[-1][1] and out[-1][2] != "PRIVATE_KEY":
                out[-1] = (out[-1][0], b, out[-1][2])
            continue
        out.append((a, b, kind))
    if positions is not None:
        out = [(positions[a], positions[b - 1] + 1 if b > a else positions[a], kind) for a, b, kind in out]
    return out


def redact(text: str | None) -> str | None:
    """The text with each credential replaced by ``[REDACTED_KIND]``; all else unchanged."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, kind in spans(text):
        if kind == "PRIVATE_KEY":  # the frame stays, the key between goes; its line ends stay
            head = text.find("\n", a, b)
            a = b if head < 0 else head
            inner = text[a:b]
            parts += [text[at:a], re.sub(r"[^\r\n]+", "", inner).replace("\n", "\n[REDACTED]", 1) if inner.strip() else inner]
        else:
            parts += [text[at:a], f"[REDACTED_{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


def redact_bytes(raw: bytes) -> bytes:
    """:func:`redact` on the bytes of a file: those outside the credentials stay as they are, whatever they are."""
    return redact(raw.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def starts(text: str | None) -> list[int]:
    """The 1-based lines on which at least one credential begins."""
    if not text:
        return []
    got = spans(text)
    if not got:
        return []
    breaks = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect_right(breaks, a - 1) + 1 for a, _, _ in got})


def value_is_credential(text: str | None, key: str) -> bool:
    """Whether a whole value, known by its key path, is or holds a credential."""
    if not text or not text.strip():
        return False
    folded = fold(text)[0].strip()
    if sensitive(key) and secret_value(folded, True):
        return True
    return bool(spans(text))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lines = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n in starts(text):
                keys.append(key)
                lines.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int32())], names=["row_key", "line_no"])


def credential_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row_key, line_no`` of every line on which a credential begins; a replayed row counts once."""
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(_lines, "row_key bigint, line_no int").distinct()


def value_credentials(df: DataFrame, key: str, value: str, path: str) -> DataFrame:
    """The same for whole values of one key path, such as a member of a payload."""

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series([value_is_credential(v, path) for v in values], dtype=bool)

    return df.where(F.col(value).isNotNull()).select(F.col(key).alias("row_key"), F.col(value).alias("v")).where(test("v")).select("row_key", F.lit(1).cast("int").alias("line_no")).distinct()


def redacted(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """Add ``text`` with its credentials redacted."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], dtype=object)

    return df.withColumn(out, run(text))


def found(content: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every case of content and of the payloads' two configuration members."""
    tag = lambda src, df: df.select(F.lit(src).alias("src"), "row_key", "line_no")
    return (
        tag("content", credential_lines(content, "record_id", "content"))
        .unionByName(tag("api_key", value_credentials(payloads, "sample_id", "config.api_key", "config.api_key")))
        .unionByName(tag("database_url", value_credentials(payloads, "sample_id", "config.database_url", "config.database_url")))
    )
