"""The pipeline over a DataFrame of contents: detect, reconcile, decide, rewrite, verify.

One narrow stage: every row is worked on where it lies, and nothing is shuffled. The result keeps the
detected spans without their texts; a row's artifact is NULL unless every gate was passed.

Gates, in this order: a destination needed but not given, coverage not complete, a type that blocks any
artifact, and something left that should have gone. Defined results: NULL content is read as empty;
blank content gives no entities and, in scrubbing, incomplete coverage; extra columns pass through
untouched unless their name is that of a result column.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.operators import injection
from veilspark.operators.chunks import chunks
from veilspark.operators.detect import Entity, Ner, detect, masked_preview
from veilspark.operators.normalize import signals
from veilspark.operators.policy import Profile, decide, pending_destinations, relevant, resolve
from veilspark.operators.reconcile import Stats, reconcile
from veilspark.operators.rewrite import Vault, apply, verify
from veilspark.operators.vault import NOTHING, Allowlist


@dataclass(frozen=True)
class Options:
    profiles: tuple[str, ...] = ("DEFAULT_PII",)
    destination: str | None = None
    requested_action: str | None = None
    threshold: float | None = None
    chunk_size: int | None = None
    max_bytes: int | None = None
    truncation_approved: bool = False
    dry_run: bool = False
    #: A named-entity detector, called once a chunk; profiles that require one are refused without it.
    ner: Ner | None = None
    #: The key of surrogates and digests; drawn at random for each run if not given.
    salt: bytes | None = None
    pbkdf2_rounds: int = lx.PBKDF2_ROUNDS


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ENTITY = pa.struct([
    ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("severity", pa.string()), ("preview", pa.string()), ("detected_by", pa.list_(pa.string())),
    ("is_base_security", pa.bool_()), ("trimmed", pa.bool_()), ("mandated", pa.string()), ("applied", pa.string()), ("rule", pa.string()), ("discarded", pa.bool_()),
])
_FINDING = pa.struct([("kind", pa.string()), ("description", pa.string()), ("occurrences", pa.int32()), ("spans", pa.list_(_SPAN))])
_DETECTOR = pa.struct([("detector", pa.string()), ("executed", pa.bool_()), ("failed", pa.bool_()), ("reason", pa.string())])
_STATS = pa.struct([(name, pa.int32()) for name in Stats.__dataclass_fields__])
_RESULT = pa.schema([
    ("key", pa.string()), ("entities", pa.list_(_ENTITY)), ("findings", pa.list_(_FINDING)), ("detectors", pa.list_(_DETECTOR)), ("reconciliation", _STATS), ("warnings", pa.list_(pa.string())),
    ("bytes_total", pa.int64()), ("bytes_processed", pa.int64()), ("chunks_total", pa.int32()), ("chunks_done", pa.int32()), ("truncated", pa.bool_()), ("complete", pa.bool_()), ("refusal", pa.string()),
    ("pending", pa.list_(pa.string())), ("residual", pa.list_(pa.string())), ("suppressed", pa.int32()), ("artifact", pa.string()), ("verified_clean", pa.bool_()),
])


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in t) + ">"
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    return {"string": "string", "int32": "int", "int64": "bigint", "double": "double", "bool": "boolean"}[str(t)]


RESULT = ", ".join(f"{f.name} {_ddl(f.type)}" for f in _RESULT)


class Ledger:
    """Which detectors ran, and how they did. One that failed on any chunk, or was not there, is not healthy."""

    def __init__(self, profile: Profile, ner: Ner | None) -> None:
        self.reasons: dict[str, str | None] = {"custom_security": None, "presidio": None}
        self.ran: set[str] = set()
        self.ner = ner
        for name in sorted({*profile.required, "spacy"} - set(self.reasons)):
            self.reasons[name] = None if name == "spacy" and ner else "not available"

    def _guarded(self, text: str) -> list[tuple[str, int, int]]:
        self.ran.add("spacy")
        try:
            return [(kind, a, b) for kind, a, b in self.ner(text) if 0 <= a < b <= len(text)]
        except Exception as e:  # whatever a plug-in raises is a failed detector, not a failed job
            self.reasons["spacy"] = f"failed: {type(e).__name__}"
            return []

    def detect(self, text: str, threshold: float, profile: Profile) -> list[Entity]:
        self.ran |= {"custom_security", "presidio"}
        return detect(text, threshold, self._guarded if self.ner else None, profile.types)

    def healthy(self) -> set[str]:
        return {name for name, reason in self.reasons.items() if reason is None}

    def rows(self) -> list[dict]:
        return [{"detector": n, "executed": n in self.ran, "failed": bool(r and r.startswith("failed")), "reason": r} for n, r in sorted(self.reasons.items())]


def process(text: str | None, options: Options, scrub: bool, vault: Vault, allowed: Allowlist = NOTHING) -> dict:
    """One content. ``allowed`` has digests of values confirmed to be false positives."""
    text = text or ""
    profile = resolve(*options.profiles)
    ledger = Ledger(profile, options.ner)
    found_text = [{"kind": k, "description": d, "occurrences": n, "spans": [{"start": a, "end": b} for a, b in spans]} for k, d, n, spans in injection.findings(text)]
    out: dict = dict.fromkeys(_RESULT.names) | {"entities": [], "findings": found_text, "warnings": [], "pending": [], "residual": [], "bytes_processed": 0, "chunks_total": 0, "chunks_done": 0, "truncated": False, "suppressed": 0, "verified_clean": False}
    blank = not text.strip()
    out["bytes_total"] = 0 if blank else len(text.encode())
    kept: list[Entity] = []
    stats = Stats()
    if not blank:
        parts = chunks(text, profile.span, options.chunk_size)
        out["chunks_total"] = len(parts)
        found: list[Entity] = []
        least = min(lx.DEFAULT_THRESHOLD if options.threshold is None else options.threshold, 0.3)
        for a, b, overlap in parts:
            if options.max_bytes is not None and out["bytes_processed"] >= options.max_bytes:
                out["truncated"] = True
                break
            found += [e.moved(a) for e in ledger.detect(text[a:b], least, profile)]
            out["bytes_processed"] += len(text[a + overlap : b].encode())
            out["chunks_done"] += 1
        out["warnings"] += signals(text)
        kept, stats = reconcile(relevant(found, profile))
        standing = [e for e in kept if not allowed.holds(profile.name, e.text)]
        out["suppressed"], kept = len(kept) - len(standing), standing
    out["reconciliation"], out["detectors"] = dict(vars(stats)), ledger.rows()
    out["complete"] = not out["truncated"] and out["bytes_total"] > 0 and out["bytes_processed"] >= out["bytes_total"] and profile.required <= ledger.healthy()
    decisions = [decide(e, profile, text, options.destination, options.requested_action) for e in kept]
    out["entities"] = [
        {"type": e.type, "start": e.start, "end": e.end, "confidence": e.confidence, "severity": e.severity, "preview": masked_preview(e), "detected_by": e.detected_by, "is_base_security": e.is_base_security, "trimmed": e.trimmed, "mandated": d.mandated, "applied": d.applied, "rule": d.rule, "discarded": d.discarded}
        for e, d in zip(kept, decisions)
    ]
    if not options.dry_run and options.destination is None and (waiting := pending_destinations(kept, profile)):
        out["refusal"], out["pending"] = "NEEDS_DESTINATION", waiting
    elif scrub and not out["complete"]:
        out["refusal"] = "DEGRADED_COVERAGE"
    elif scrub and not options.dry_run:
        rewritten, counts, warnings = apply(text, decisions, vault)
        out["warnings"] += warnings
        if rewritten is None:
            out["refusal"] = "BLOCKED_ARTIFACT"
            return out
        permitted: dict[str, int] = {}
        for d in decisions:
            if d.applied == "ALLOW":
                permitted[d.entity.type] = permitted.get(d.entity.type, 0) + 1
        acted = {d.entity.type for d in decisions if d.applied != "ALLOW"}
        # nothing was to be removed: nothing can be left; a suppressed value stands by the user's own word
        left = verify(rewritten, profile, permitted, acted, options.ner) if acted else []
        out["residual"] = [e.type for e in left if not allowed.holds(profile.name, e.text)]
        if out["residual"]:
            out["refusal"] = "RESIDUAL_PII_DETECTED"
        else:
            out["artifact"], out["verified_clean"] = rewritten, True
    return out


def _run(df: DataFrame, key: str, text: str, options: Options, scrub: bool, allowlist: Allowlist) -> DataFrame:
    resolve(*options.profiles)  # an unknown or unsound profile is an error now, not in a task
    # one salt for the whole run: equal values come out equal in every task and every attempt of it
    salt = options.salt if options.salt is not None else secrets.token_bytes(16)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault = Vault(salt, options.pbkdf2_rounds)
        for batch in batches:
            rows = [{**process(t, options, scrub, vault, allowlist), "key": k} for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, RESULT)


def scan(df: DataFrame, key: str, text: str, options: Options | None = None, allowlist: Allowlist = NOTHING) -> DataFrame:
    """Entities, decisions, findings and coverage of every content; nothing is rewritten."""
    return _run(df, key, text, options or Options(), False, allowlist)


def scrub(df: DataFrame, key: str, text: str, options: Options | None = None, allowlist: Allowlist = NOTHING) -> DataFrame:
    """The same with an artifact where every gate was passed.

    TOKENIZE surrogates and HASH digests are keyed by the run's salt: the same in all tasks, attempts and,
    with ``Options.salt``, runs. :mod:`veilspark.operators.vault` makes the table that leads back from them.
    """
    return _run(df, key, text, options or Options(), True, allowlist)


def detected(df: DataFrame, key: str, text: str, threshold: float = 0.0, ner: Ner | None = None) -> DataFrame:
    """``key, type, start, end, confidence, detected_by, preview`` of every raw detection, overlaps included."""
    schema = pa.schema([("key", pa.string()), *((f.name, f.type) for f in _ENTITY if f.name in ("type", "start", "end", "confidence", "severity", "preview", "detected_by"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"key": k, "type": e.type, "start": e.start, "end": e.end, "confidence": e.confidence, "severity": e.severity, "preview": masked_preview(e), "detected_by": e.detected_by}
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in detect(t or "", threshold, ner)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema))


# projections of results


def entity_breakdown(result: DataFrame, *by: str) -> DataFrame:
    return result.select(*by, F.explode("entities").alias("e")).groupBy(*by, F.col("e.type").alias("type"), F.col("e.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def action_counts(result: DataFrame) -> DataFrame:
    return result.select(F.explode("entities").alias("e")).groupBy(F.col("e.applied").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def blocking_types(result: DataFrame) -> DataFrame:
    """``key, types``: the types that block a row's artifact, in order, each once."""
    return _types_where(result, lambda e: e["applied"] == "BLOCK")


def discarded_types(result: DataFrame) -> DataFrame:
    """``key, types``: the types for which a weaker request was discarded."""
    return _types_where(result, lambda e: e["discarded"])


def _types_where(result: DataFrame, holds) -> DataFrame:
    types = F.array_sort(F.array_distinct(F.transform(F.filter("entities", holds), lambda e: e["type"])))
    return result.select("key", types.alias("types")).where(F.size("types") > 0)


def residual_breakdown(result: DataFrame) -> DataFrame:
    """What verification still found, by type."""
    return result.select(F.explode("residual").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def findings_table(result: DataFrame) -> DataFrame:
    """``key, rank, type, severity, preview``: a row's entities, the severest first, then by type and place."""
    order = F.create_map(*[F.lit(x) for kv in lx.SEVERITY_RANK.items() for x in kv])
    rows = F.transform("entities", lambda e: F.struct((-order[e["severity"]]).alias("o"), e["type"].alias("type"), e["start"].alias("start"), e["severity"].alias("severity"), e["preview"].alias("preview")))
    return result.select("key", F.posexplode(F.array_sort(rows)).alias("rank", "e")).select("key", "rank", "e.type", "e.severity", "e.preview")


def llm_projection(result: DataFrame) -> DataFrame:
    """What a model may see: counts, types and masked previews, no offsets, no texts."""
    shown = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["severity"].alias("severity"), e["confidence"].alias("confidence"), e["applied"].alias("applied"), e["preview"].alias("preview")))
    return result.select("key", "refusal", "verified_clean", shown.alias("entities"), F.size("findings").alias("n_findings"), "reconciliation", "suppressed")


def describe_coverage(result: DataFrame) -> DataFrame:
    """``key, coverage``: in words, how much was scanned, by what, and why it is not complete."""
    ill = F.array_join(F.transform(F.filter("detectors", lambda d: d["reason"].isNotNull()), lambda d: F.concat(d["detector"], F.lit(" "), d["reason"])), "; ")
    text = F.concat_ws(
        "; ", F.concat(F.col("bytes_processed"), F.lit(" of "), F.col("bytes_total"), F.lit(" bytes in "), F.col("chunks_done"), F.lit(" of "), F.col("chunks_total"), F.lit(" chunks")),
        F.when(F.col("truncated"), "truncated"), F.nullif(ill, F.lit("")), F.when(F.col("complete"), "complete").otherwise("not complete"),
    )
    return result.select("key", text.alias("coverage"))


def engine_version() -> str:
    """What a result was made by: the library, its patterns and its profiles."""
    from veilspark import __version__

    state = repr((lx.LABELS, lx.LOOSE_LABELS, lx.PREFIXES, lx.GENERIC, lx.CONTEXT)), repr((lx.PROFILES, lx.DESTINATION_ACTIONS))
    return "|".join([__version__, *(hashlib.sha256(x.encode()).hexdigest()[:12] for x in state)])


def audit_projection(result: DataFrame) -> DataFrame:
    """What the audit trail holds: counts by type and action, coverage, the outcome."""
    types = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["type"])))
    return result.select(
        "key", "refusal", "verified_clean", "complete", "bytes_total", "bytes_processed", "chunks_total", F.size("entities").alias("n_entities"), types.alias("types"), F.size(F.filter("entities", lambda e: e["discarded"])).alias("n_discarded"),
        F.round(F.when(F.col("bytes_total") > 0, F.least(F.lit(1.0), F.col("bytes_processed") / F.col("bytes_total"))).otherwise(F.lit(0.0)) * 100, 1).alias("coverage_percent"),
    )
