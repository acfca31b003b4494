"""Instruction-shaped and encoded content: reported, never a reason to withhold (D11); text for prompts and transcripts."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.operators.normalize import normalized_column

SPANS_KEPT = 20

# --- fixed values: the words of instruction-shaped text ------------------------------------------------

SPEAKERS = ("system", "assistant", "user", "human", "ai")
TEMPLATE_TOKENS = ("im_start", "im_end", "endoftext", "system", "assistant", "user")
DIRECTIVES = ("system", "instruction", "note", "important")
SECTIONS = ("instruction", "system", "response")
TAGS = ("system", "instructions", "instruction", "prompt")
#: What takes back earlier instructions: verb, up to three words, which ones, what.
OVERRIDE = (("ignore", "disregard", "forget", "override"), ("previous", "prior", "earlier", "above", "all"), ("instruction", "instructions", "prompt", "prompts", "rule", "rules", "context"))
#: What claims that a scan found nothing: work, its end, none, of what.
CLAIM = (("scan", "analysis", "review"), ("complete", "completed", "finished", "done"), ("0", "no", "zero", "none"), ("pii", "finding", "findings", "issue", "issues", "sensitive"))
#: What sets an action: verb, which setting, to what.
SETTING = (("set", "use", "apply"), ("requested_action", "action", "scrub_action"), ("allow", "none", "skip"))
#: What skips the work: verb, up to two words, which work.
SKIP = (("skip", "bypass", "disable", "suppress"), ("redaction", "scrubbing", "detection", "sanitization", "sanitisation"))
#: What has content reported as clean: up to three words before "as".
REPORT = (("report",), ("clean", "safe", "verified"))


def _any(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


def _within(n: int) -> str:
    """Blanks, and up to n words between."""
    return rf"[ \t]{{1,4}}(?:\w{{1,40}}[ \t]{{1,4}}){{0,{n}}}"


# Java and Python read these alike.
_ROLE = rf"(?im)^[ \t]{{0,8}}{_any(SPEAKERS)}[ \t]{{0,4}}:"
_TEMPLATE = rf"<\|{_any(TEMPLATE_TOKENS)}\|>"
_BRACKETED = rf"\[\[[ \t]{{0,4}}(?i:{'|'.join(DIRECTIVES)})\b"
KINDS = (
    ("injection:role_marker", _ROLE, "text formatted as a chat role marker"),
    ("injection:chat_template_token", _TEMPLATE, "chat template control tokens"),
    ("injection:bracketed_directive", _BRACKETED, "bracketed directive block"),
    ("injection:instruction_override", rf"(?i)\b{_any(OVERRIDE[0])}{_within(3)}{_any(OVERRIDE[1])}[ \t]{{1,4}}{_any(OVERRIDE[2])}\b", "instruction-override phrasing"),
    ("injection:false_completion_claim", rf"(?i)\b{_any(CLAIM[0])}[ \t]{{1,4}}{_any(CLAIM[1])}\b[^\n]{{0,60}}?\b{_any(CLAIM[2])}\b[^\n]{{0,20}}?\b{_any(CLAIM[3])}\b", "a false claim that scanning found nothing"),
    ("injection:action_directive", rf"(?i)\b{_any(SETTING[0])}[ \t]{{0,4}}{_any(SETTING[1])}[ \t]{{0,4}}[=:][ \t]{{0,4}}{_any(SETTING[2])}", "an attempt to set a scrub action directly"),
    ("injection:skip_directive", rf"(?i)\b{_any(SKIP[0])}{_within(2)}{_any(SKIP[1])}\b", "an attempt to skip redaction"),
    ("injection:report_clean_directive", rf"(?i)\b{_any(REPORT[0])}{_within(3)}as[ \t]{{1,4}}{_any(REPORT[1])}\b", "an instruction to report content as clean"),
)
_KINDS = [(kind, re.compile(pattern), text) for kind, pattern, text in KINDS]

# --- encoded and divided values --------------------------------------------------------------------------

#: Names before a mark, and prefixes, that make a decoded value look like a credential.
SECRET_NAMES = ("password", "passwd", "api_key", "api-key", "apikey", "secret", "token")
_PREFIXES = r"(?:sk-[A-Za-z0-9_\-]{16,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-)"
_CREDENTIAL = re.compile(rf"(?i){_PREFIXES}|-----BEGIN|\b(?:{'|'.join(SECRET_NAMES)}|bearer)\b[ \t]{{0,4}}[:=]")
_B64_RUN = re.compile(r"\b[A-Za-z0-9+/]{20,512}={0,2}")
_HEX_RUN = re.compile(r"\b(?:[0-9a-fA-F]{2}){10,256}\b")
_DIGIT_FIELD = r"\b\w{1,20}[ \t]{0,4}[=:][ \t]{0,4}[0-9]{2,4}\b"
_DIVIDED = re.compile(rf"{_DIGIT_FIELD}(?:[ \t,;]{{1,4}}{_DIGIT_FIELD}){{2,}}")


def _base64_bytes(value: str) -> bytes | None:
    try:
        return base64.b64decode(value.rstrip("=") + "=" * (-len(value.rstrip("=")) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _credential_inside(raw: bytes | None) -> bool:
    """Whether decoded bytes are text that holds a credential."""
    try:
        return raw is not None and _CREDENTIAL.search(raw.decode("utf-8")) is not None
    except UnicodeDecodeError:
        return False


_DECODED: tuple[tuple[str, re.Pattern, str, Callable[[str], bool]], ...] = (
    ("encoded:base64", _B64_RUN, "base64 value decoding to credential-shaped data", lambda v: _credential_inside(_base64_bytes(v))),
    ("encoded:hex", _HEX_RUN, "hex value decoding to credential-shaped data", lambda v: _credential_inside(bytes.fromhex(v))),
    ("evasion:split_fields", _DIVIDED, "numeric value apparently split across adjacent fields", lambda v: True),
)


def findings(text: str) -> list[tuple[str, str, int, list[tuple[int, int]]]]:
    """(kind, description, occurrences, the first spans)."""
    out = []
    for kind, pattern, described, counts in (*((k, p, d, lambda v: True) for k, p, d in _KINDS), *_DECODED):
        spans = [m.span() for m in pattern.finditer(text) if counts(m[0])]
        if spans:
            out.append((kind, described, len(spans), spans[:SPANS_KEPT]))
    return out


# --- native forms ------------------------------------------------------------------------------------------


def injection_counts(text: Column) -> dict[str, Column]:
    """Occurrences by kind of what regular expressions alone can tell, in the JVM."""
    return {kind: F.regexp_count(text, F.lit(p)) for kind, p, _ in KINDS}


def _replacing(pattern: str, name: str) -> str:
    """The pattern with its words in a group, so that a replacement can keep them."""
    return pattern.replace(f"{name}", f"({name.removeprefix('(?:').removesuffix(')')})")


#: What is defanged in text meant for a prompt, and how: a word joiner after a speaker, marks that no template reads.
NEUTRALISED = (
    (_replacing(_ROLE, _any(SPEAKERS)), "$1\u2060:"),
    (_TEMPLATE, "<!marker!>"),
    (_BRACKETED, "[!directive!"),
    (rf"(?i)###[ \t]{{0,4}}({'|'.join(SECTIONS)})", "##!$1"),
    (rf"(?i)</?{_any(TAGS)}>", "<!tag!>"),
)


def neutralised(text: Column, limit: int = lx.MAX_PROMPT_CHARS) -> Column:
    """Instruction-shaped sequences defanged, the text cut to what a prompt may hold."""
    omitted = F.concat(F.lit("\n[... "), F.format_number(F.length(text) - limit, 0), F.lit(" more characters omitted]"))
    out = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), omitted)).otherwise(text)
    for pattern, by in NEUTRALISED:
        out = F.regexp_replace(out, pattern, by)
    return out


def enveloped(text: Column, envelope: str, label: str = "excerpt") -> Column:
    tag = f'untrusted_data id="{envelope}"'
    return F.concat(F.lit(f'<{tag} label="{label}">\n'), neutralised(text), F.lit(f"\n</{tag}>"))


#: Shapes never kept in a stored transcript, and what stands for them. Java and RE2 read these alike.
TRANSCRIPT = (
    (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", "[REDACTED_SECRET]"),
    (r"sk-[A-Za-z0-9_\-]{16,}", "[REDACTED_SECRET]"),
    (r"AKIA[A-Z0-9]{16}", "[REDACTED_SECRET]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    (r"xox[abprs]-[A-Za-z0-9\-]{10,}", "[REDACTED_SECRET]"),
    (r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*", "[REDACTED_SECRET]"),
    (r"://[^:/@ \t\r\n]{1,64}:[^@/ \t\r\n]{1,128}@", "://[REDACTED_SECRET]@"),
    (rf"(?i)(?:{'|'.join(SECRET_NAMES)})[ \t]{{0,4}}[:=][ \t]{{0,4}}[^ \t\r\n]{{6,}}", "[REDACTED_SECRET]"),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[US_SSN]"),
    (r"[0-9](?:[ -]?[0-9]){12,18}", "[CARD_NUMBER]"),
    (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}", "[EMAIL_ADDRESS]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP_ADDRESS]"),
)


def transcript(text: Column) -> Column:
    """Text fit for stored history: secret shapes, then identifiers, replaced after normalisation."""
    out = normalized_column(text)
    for pattern, by in TRANSCRIPT:
        out = F.regexp_replace(out, pattern, by)
    return out


def short_error(message: Column) -> Column:
    """The first line of an error with paths shortened to their last part, 400 characters at most."""
    line = F.substring_index(message, "\n", 1)
    return F.left(F.regexp_replace(line, r"(?:[A-Za-z]:)?(?:[/\\][\w.\-]+)+[/\\]([\w.\-]+)", "$1"), F.lit(400))
