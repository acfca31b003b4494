"""The public surface: detect, scan, scrub, list sources, explain and list profiles, options, health, SQL functions."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession

from veilspark import lexicon as lx
from veilspark.functions.text import register as register_functions
from veilspark.operators.detect import masked_preview
from veilspark.operators.logparse import parse_logs
from veilspark.operators.policy import resolve
from veilspark.operators.scrub import Options, detected, engine_version, scan, scrub
from veilspark.sources.files import list_sources


def detect(df: DataFrame, key: str, text: str, threshold: float = 0.0, ner=None) -> DataFrame:
    """``key, type, start, end, confidence, severity, preview, detected_by`` of every detection in a column of texts."""
    return detected(df, key, text, threshold, ner)


def explain_profile(*names: str) -> dict:
    """Rules in force, sensitive destinations, detectors required and the widest span."""
    return resolve(*names).explain()


def catalog() -> list[dict]:
    """All types that can be found, the severest first: who finds them, and the profiles that act on them."""
    custom = {kind: "custom_security" for kind in lx.CUSTOM}
    found_by = custom | {kind: "presidio" for kind, *_ in lx.GENERIC} | dict.fromkeys(("PERSON", "LOCATION", "ORGANIZATION", "NRP"), "spacy")
    rows = [{"type": t, "severity": lx.severity(t), "detector": d, "profiles": sorted(name for name, p in lx.PROFILES.items() if t in p.rules)} for t, d in found_by.items()]
    return sorted(rows, key=lambda r: (-lx.SEVERITY_RANK[r["severity"]], r["type"]))


#: What a refusal means and what to do about it.
REFUSAL_TEXTS = {
    "NEEDS_DESTINATION": "Types were found whose handling depends on where the result goes. Name a destination and run again.",
    "DEGRADED_COVERAGE": "Not all of the content was scanned by all detectors that the profile requires. No artifact was made.",
    "BLOCKED_ARTIFACT": "The content holds a type that must not leave in any form. No artifact was made.",
    "RESIDUAL_PII_DETECTED": "A second scan of the rewritten content still found something. The artifact was withheld.",
}


def refusal_text(code: str | None, pending: list[str] | None = None) -> str:
    if code is None:
        return ""
    return REFUSAL_TEXTS[code] + (f" Types: {', '.join(pending)}." if pending else "")


_COERCED = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}


class Preferences:
    """Options of a session. An argument of a call counts before a preference, a preference before the default."""

    def __init__(self) -> None:
        self.values: dict = {}

    def set(self, name: str, value) -> None:
        """Set one preference, with texts read as what the option is; ``None`` takes it back."""
        known = {f.name for f in fields(Options)} - {"ner", "salt"}
        if name not in known:
            raise ValueError(f"unknown option {name}; there are {', '.join(sorted(known))}")
        if value is None:
            self.values.pop(name, None)
            return
        if name == "profiles":
            value = tuple(x.strip() for x in value.split(",")) if isinstance(value, str) else tuple(value)
            resolve(*value)
        elif name in ("truncation_approved", "dry_run"):
            value = _COERCED[value.strip().lower()] if isinstance(value, str) else bool(value)
        elif name in ("chunk_size", "max_bytes", "pbkdf2_rounds"):
            value = int(value)
        elif name == "threshold":
            value = float(value)
            if not 0 <= value <= 1:
                raise ValueError("threshold outside 0..1")
        elif name == "destination" and value not in lx.DESTINATIONS or name == "requested_action" and value not in lx.ACTIONS:
            raise ValueError(f"{value} is no {name}")
        self.values[name] = value

    def options(self, **arguments) -> Options:
        return replace(Options(), **{**self.values, **{k: v for k, v in arguments.items() if v is not None}})


OK, DEGRADED, UNAVAILABLE = "ok", "degraded", "unavailable"


def health(spark: SparkSession, ner=None, roots: list[str] = (), audit: str | None = None) -> list[dict]:
    """State of each component, and whether its failure blocks artifacts."""
    out = []

    def check(name: str, blocks: bool, probe, otherwise: str = UNAVAILABLE) -> None:
        try:
            detail = probe()
            out.append({"component": name, "status": OK if detail is not None else otherwise, "detail": detail or "not there", "blocks_scrubbing": blocks})
        except Exception as e:  # a component that fails in any way is a finding, not an error
            out.append({"component": name, "status": otherwise, "detail": type(e).__name__, "blocks_scrubbing": blocks})

    def there(path: str):
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        return path if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm) else None

    from veilspark.operators.detect import detect as of_text

    check("patterns", True, lambda: "found" if of_text("password=hunter2secret") else None)
    check("named entities", True, lambda: None if ner is None else f"{len(ner('Probe'))} in a probe")
    check("profiles", True, lambda: f"{len([resolve(p) for p in lx.PROFILES])} profiles")
    check("engine version", False, engine_version)
    check("audit", True, lambda: there(audit) if audit else None, DEGRADED)
    check("roots", False, lambda: f"{len(roots)} roots" if roots and all(map(there, roots)) else None, DEGRADED)
    return out


def overall(components: list[dict]) -> str:
    """The worst state of all."""
    states = {c["status"] for c in components}
    return next((s for s in (UNAVAILABLE, DEGRADED) if s in states), OK)


def blockers(components: list[dict]) -> list[str]:
    """Components whose failure blocks artifacts."""
    return [c["component"] for c in components if c["blocks_scrubbing"] and c["status"] != OK]


__all__ = [
    "Options", "Preferences", "blockers", "catalog", "detect", "explain_profile", "health", "list_sources", "masked_preview", "overall", "parse_logs", "refusal_text", "register_functions", "scan", "scrub",
]
