"""Hash-chained audit records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

GENESIS = "0" * 64
#: Names that a record must not have at any depth: they could carry what was found.
FORBIDDEN = frozenset({"text", "content", "raw_content", "value", "matched_text", "entity_text", "sanitized", "excerpt", "source_identifier"})


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), default=str)


def forbidden(record, path: str = "") -> list[str]:
    """Paths of forbidden names in a record."""
    if isinstance(record, dict):
        return [p for k, v in record.items() for p in ([f"{path}{k}"] if str(k).lower() in FORBIDDEN else forbidden(v, f"{path}{k}."))]
    if isinstance(record, (list, tuple)):
        return [p for v in record for p in forbidden(v, path)]
    return []


def forbidden_columns(schema: StructType, path: str = "") -> list[str]:
    """Paths of forbidden names in a schema, at any depth."""
    out = []
    for f in schema.fields:
        here, of = f"{path}{f.name}", f.dataType
        if f.name.lower() in FORBIDDEN:
            out.append(here)
            continue
        while isinstance(of, ArrayType):
            of = of.elementType
        if isinstance(of, StructType):
            out += forbidden_columns(of, f"{here}.")
    return out


def chain(records: Iterable[dict], last: str = GENESIS) -> list[dict]:
    """Append records to a chain: each names the hash of the one before."""
    out = []
    for r in records:
        if bad := forbidden(r):
            raise ValueError(f"audit records must not hold {', '.join(bad)}")
        entry = {**{k: v for k, v in r.items() if k != "record_hash"}, "prev_hash": last}
        last = hashlib.sha256(canonical(entry).encode()).hexdigest()
        out.append({**entry, "record_hash": last})
    return out


def intact(records: list[dict], last: str = GENESIS) -> bool:
    for r in records:
        body = {k: v for k, v in r.items() if k != "record_hash"}
        if r.get("prev_hash") != last or hashlib.sha256(canonical(body).encode()).hexdigest() != r.get("record_hash"):
            return False
        last = r["record_hash"]
    return True


def broken_links(chained: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of stored chains (payload, prev_hash, record_hash) whose hash or link is wrong."""
    w = Window.partitionBy(by).orderBy(order)
    return (
        chained.withColumn("_want", F.coalesce(F.lag("record_hash").over(w), F.lit(GENESIS)))
        .where((F.col("prev_hash") != F.col("_want")) | (F.sha2(F.concat("payload", F.lit("|"), "prev_hash"), 256) != F.col("record_hash")))
        .drop("_want")
    )
