"""Structured contents flattened to path and value."""

from __future__ import annotations

import csv
import io
import json
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import lexicon as lx


class Refused(ValueError):
    """Content that is not parsed as what it claims to be; it is scanned as plain text instead."""


Field = tuple[str, str, bool]


def flatten(node, path: str = "") -> list[Field]:
    """Keys as (path, key, True) and leaves as (path, text, False), in document order; nulls are dropped."""
    out: list[Field] = []
    seen = 0
    todo = [(node, path, 0)]
    while todo:
        value, at, depth = todo.pop()
        if at is None:  # a key's own row, held back until its turn
            out.append(value)
            continue
        seen += 1
        if depth > lx.MAX_DEPTH or seen > lx.MAX_NODES:
            raise Refused(f"nests deeper than {lx.MAX_DEPTH} or holds more than {lx.MAX_NODES} nodes")
        if isinstance(value, dict):
            for k, v in reversed(value.items()):
                child = f"{at}.{k}" if at else str(k)
                todo += [(v, child, depth + 1), ((child, str(k), True), None, 0)]
        elif isinstance(value, list):
            todo += [(v, f"{at}[{i}]", depth + 1) for i, v in reversed(list(enumerate(value)))]
        elif value is not None:
            out.append((at or "$", str(value), False))
    return out


def json_fields(text: str) -> list[Field]:
    try:
        return flatten(json.loads(text))
    except (RecursionError, json.JSONDecodeError) as e:
        raise Refused(f"not JSON: {type(e).__name__}") from None


def jsonl_fields(text: str) -> list[Field]:
    """Line by line; a line that is no JSON stands as it is."""
    out: list[Field] = []
    for n, line in enumerate(text.splitlines(), 1):
        if line := line.strip():
            try:
                out += flatten(json.loads(line), f"line[{n}]")
            except (json.JSONDecodeError, RecursionError):
                out.append((f"line[{n}]", line, False))
    return out


def xml_fields(text: str) -> list[Field]:
    """Elements and attributes; document types and entities are refused before they can do anything."""
    out: list[Field] = []
    path: list[str] = []
    tails: list[bool] = []
    buffer: list[str] = []
    nodes = 0
    parser = expat.ParserCreate()

    def refuse(*_):
        raise Refused("document types, entities and external references are not processed")

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    pending: list[list[Field]] = [[]]

    def flush() -> None:
        if value := "".join(buffer).strip():
            if tails and tails[-1]:
                pending[-1].append((tails_path[-1], value, False))
            elif path:
                out.append(("/".join(path), value, False))
        buffer.clear()

    tails_path: list[str] = []

    def start(tag: str, attributes: dict) -> None:
        nonlocal nodes
        flush()
        if pending[-1]:
            out.extend(pending[-1])
            pending[-1].clear()
        nodes += 1
        path.append(tag)
        if len(path) - 1 > lx.MAX_DEPTH or nodes > lx.MAX_NODES:
            raise Refused("nests too deeply or holds too many nodes")
        here = "/".join(path)
        for k, v in attributes.items():
            out.extend([(f"{here}@{k}", k, True), (f"{here}@{k}", v, False)])
        tails.append(False)
        tails_path.append("")
        pending.append([])

    def end(_: str) -> None:
        flush()
        out.extend(pending.pop())
        here = "/".join(path)
        path.pop()
        tails.pop()
        tails_path.pop()
        if tails:
            tails[-1], tails_path[-1] = True, f"{here}#tail"

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, buffer.append
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise Refused(f"not XML: {e}") from None
    return out


def csv_fields(text: str) -> list[Field]:
    try:
        dialect = csv.Sniffer().sniff(text[:8192]) if text[:8192].strip() else csv.excel
    except csv.Error:
        dialect = csv.excel
    out: list[Field] = []
    header: list[str] = []
    for n, row in enumerate(csv.reader(io.StringIO(text), dialect)):
        if len(row) > lx.MAX_CSV_FIELDS or sum(map(len, row)) > lx.MAX_CSV_ROW:
            raise Refused(f"row {n + 1} is over the limits")
        if n == 0:
            header = [c.strip() for c in row]
            out += [("header", c, True) for c in header if c]
        else:
            out += [(f"row[{n}].{header[k] if k < len(header) and header[k] else f'col{k}'}", c, False) for k, c in enumerate(row) if c.strip()]
    return out


PARSERS = {"json": json_fields, "jsonl": jsonl_fields, "xml": xml_fields, "csv": csv_fields}


def scannable(text: str, extension: str) -> tuple[str, list[Field], str | None]:
    """The text that offsets refer to, the fields, and why it fell back to plain text, if it did."""
    parser = PARSERS.get(extension.lower().lstrip("."))
    if parser is None:
        return text, [], None
    try:
        fields = parser(text)
    except Refused as e:
        return text, [], str(e)
    return "\n".join(f"{p}: {v}" for p, v, _ in fields), fields, None


_FIELDS = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string()), ("is_key", pa.bool_())]))


def flattened(df: DataFrame, key: str, text: str, extension: str) -> DataFrame:
    """``key, scannable, fields, fallback`` of every structured content; NULL is read as empty."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, t, e in zip(*(c.to_pylist() for c in batch.columns)):
                whole, fields, why = scannable(t or "", e or "")
                rows.append({"key": k, "scannable": whole, "fields": [{"path": p, "value": v, "is_key": b} for p, v, b in fields], "fallback": why})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("scannable", pa.string()), ("fields", _FIELDS), ("fallback", pa.string())]))

    return df.select(F.col(key).cast("string"), text, extension).mapInArrow(run, "key string, scannable string, fields array<struct<path:string,value:string,is_key:boolean>>, fallback string")
