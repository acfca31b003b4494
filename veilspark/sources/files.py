"""Files, uploads and pasted texts in, artifacts out.

Nothing is left out in silence: every input comes out either with its content or with the reason why it was
refused, and a structured file that could not be parsed as such says so and is read as plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.sources import parse

# fixed values: names and folders never read, whatever their extension
DENIED_NAMES = (".env", ".env.*", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "*.pem", "*.pfx", "*.p12", "*.key", "credentials", "credentials.*", ".htpasswd", "*.kdbx")
DENIED_FOLDERS = (".aws", ".ssh", ".kube", ".gnupg", ".docker", ".azure", ".config/gcloud")
#: Kinds of payload in the object store.
PAYLOAD_KINDS = ("original", "sanitized", "chunk")


def _glob(pattern: str) -> str:
    return re.escape(pattern).replace(r"\*", ".*")


_NAMES = "(?i)^(?:" + "|".join(map(_glob, DENIED_NAMES)) + ")$"
_FOLDERS = "(?i)(?:^|/)(?:" + "|".join(map(_glob, DENIED_FOLDERS)) + ")(?:/|$)"
#: Parts of dots only, the ways to write them in a URL, and bytes that end a name early.
_TRAVERSAL = r"(?i)(?:^|/)\s*\.{2,}\s*(?:/|$)|%2e%2e|\.\.%2f|%252e|\x00"


def path_problem(path: Column) -> Column:
    """Why a path relative to its root is refused; NULL if it may be read."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.substring_index(unix, "/", -1)
    folder = F.regexp_replace(unix, "[^/]*$", "")
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(unix.rlike(_TRAVERSAL), "traversal")
        .when(unix.rlike(r"^(?:/|[A-Za-z]:|~)"), "absolute")
        .when(folder.rlike(_FOLDERS), "sensitive folder")
        .when(name.rlike(_NAMES), "sensitive name")
        .when(~extension.isin(*lx.EXTENSIONS), "extension")
    )


def contained(path: Column, roots: list[str]) -> Column:
    """Whether a full path lies inside one of the roots: by whole names, so ``/data-old`` is not inside ``/data``."""
    clean = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    inside = [F.startswith(clean, F.lit("/" + re.sub("^[a-z0-9]+:/*", "", r).strip("/") + "/")) for r in roots]
    return reduce(lambda a, b: a | b, inside, F.lit(False)) & ~clean.rlike(_TRAVERSAL)


def _named(spark: SparkSession, root: str, with_content: bool) -> DataFrame:
    base = root.rstrip("/")
    glob = "{" + ",".join(f"*.{e}" for e in lx.EXTENSIONS) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.split("://")[-1].lstrip("/")) + "/", "")
    columns = [relative.alias("path"), F.col("path").alias("full_path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at")]
    return raw.select(*columns, *([F.col("content").alias("raw")] if with_content else [])).where(contained(F.col("full_path"), [base]))


def list_sources(spark: SparkSession, root: str, limit: int = 100) -> DataFrame:
    """``path, extension, n_bytes, modified_at`` of the first files under a root that may be read, by path; contents are not read."""
    files = _named(spark, root, False).where(path_problem(F.col("path")).isNull())
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "n_bytes", "modified_at").orderBy("path").limit(limit)


def taken(df: DataFrame, name: str, raw: str) -> DataFrame:
    """Files or uploads (name, bytes) decoded, parsed and checked: ``path, extension, n_bytes, content, fields,
    replaced, warning, refusal``.

    Bytes that are no UTF-8 come out as U+FFFD and are counted. What is over the limit or may not be read has
    a refusal and no content; what is no valid structure of its extension has a warning and its plain text.
    """
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    size = F.octet_length(raw)
    refusal = F.coalesce(path_problem(F.col(name)), F.when(size > lx.MAX_FILE_BYTES, F.concat(F.lit("larger than "), F.lit(lx.MAX_FILE_BYTES), F.lit(" bytes"))))
    text = F.when(refusal.isNull(), F.expr(f"make_valid_utf8(cast(`{raw}` as string))"))
    known = df.select(F.col(name).alias("path"), extension.alias("extension"), size.cast("bigint").alias("n_bytes"), text.alias("text"), refusal.alias("refusal"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, n, text, why in zip(*(c.to_pylist() for c in batch.columns)):
                whole, fields, fallback = (None, [], None) if text is None else parse.scannable(text, ext or "")
                rows.append({"path": path, "extension": ext, "n_bytes": n, "content": whole, "fields": [{"path": p, "value": v, "is_key": k} for p, v, k in fields], "replaced": (text or "").count("�"), "warning": fallback, "refusal": why})
            yield pa.RecordBatch.from_pylist(rows, schema=_TAKEN)

    return known.mapInArrow(run, "path string, extension string, n_bytes bigint, content string, fields array<struct<path:string,value:string,is_key:boolean>>, replaced int, warning string, refusal string")


_TAKEN = pa.schema([
    ("path", pa.string()), ("extension", pa.string()), ("n_bytes", pa.int64()), ("content", pa.string()), ("fields", pa.list_(pa.struct([("path", pa.string()), ("value", pa.string()), ("is_key", pa.bool_())]))),
    ("replaced", pa.int32()), ("warning", pa.string()), ("refusal", pa.string()),
])


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """:func:`taken` of the files under a root; offsets of findings refer to its ``content``."""
    return taken(_named(spark, root, True), "path", "raw")


def pasted(texts: DataFrame, text: str = "content") -> DataFrame:
    """Pasted texts with a ``refusal`` where one is too long or NULL; a refused text is not kept."""
    why = F.when(F.col(text).isNull(), "no text").when(F.length(text) > lx.MAX_TEXT_CHARS, F.concat(F.lit("longer than "), F.lit(lx.MAX_TEXT_CHARS), F.lit(" characters")))
    return texts.withColumn("refusal", why).withColumn(text, F.when(F.col("refusal").isNull(), F.col(text)))


# --- content store ---------------------------------------------------------------------------------------


def newest_by_label(records: DataFrame, label: str, order: str) -> DataFrame:
    """Of the records not sanitized the newest whose label is this one, apart from case."""
    return records.where((F.lower("label") == label.lower()) & ~F.coalesce(F.col("is_sanitized"), F.lit(False))).orderBy(F.desc(order)).limit(1)


def sanitized_records(records: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Records made of artifacts that passed every gate, with the record each is derived from."""
    passed = result.where("artifact is not null and verified_clean").select(F.col("key").alias("derived_from"), F.col("artifact").alias("content"))
    return records.select(F.col(key).cast("string").alias("derived_from"), "label").join(passed, "derived_from").select(
        F.concat(F.lit("san-"), F.substring(F.sha2(F.concat_ws("|", "derived_from", "content"), 256), 1, 20)).alias("handle"), "derived_from", "label", "content", F.lit(True).alias("is_sanitized")
    )


# --- sinks --------------------------------------------------------------------------------------------------


def export_artifacts(result: DataFrame, path: str) -> None:
    """Write only what passed every gate, by name and cleaned text."""
    result.where("artifact is not null and verified_clean").select(F.concat("key", F.lit("-cleaned")).alias("name"), "artifact").write.mode("overwrite").parquet(path)


def export_findings(result: DataFrame, path: str) -> None:
    """Findings without any text, as JSON lines."""
    result.select(F.concat("key", F.lit("-findings")).alias("name"), "entities", "findings", "refusal").write.mode("overwrite").json(path)


def append_audit(records: DataFrame, path: str, at: str, chain: str, order: list[str]) -> None:
    """Audit records, hash-chained and appended by UTC day; a schema that could carry findings is refused.

    A record's payload is the JSON of its columns; ``chain`` names the chain it belongs to.
    """
    from veilspark.operators.audit import forbidden_columns
    from veilspark.operators.store import linked

    if bad := forbidden_columns(records.schema):
        raise ValueError(f"audit records must not hold {', '.join(bad)}")
    rows = records.select(chain, *[c for c in order if c != chain], F.col(at).alias("_at"), F.to_json(F.struct(*records.columns)).alias("payload"))
    linked(rows, chain, order, "payload").withColumn("day", F.to_date("_at")).drop("_at").write.mode("append").partitionBy("day").json(path)


def read_audit(spark: SparkSession, path: str, chain: str, order: list[str]) -> DataFrame:
    """All audit records in the order of their chains."""
    return spark.read.json(path).orderBy("day", chain, *order)


# --- objects ------------------------------------------------------------------------------------------------


def object_key(workspace: str, kind: str, name: str) -> str:
    """workspace/kind/id: opaque, the workspace first, the kind one of the known ones."""
    if kind not in PAYLOAD_KINDS:
        raise ValueError(f"unknown kind of payload {kind!r}")
    return object_path("", workspace, kind, name).lstrip("/")


def object_path(root: str, *parts: str) -> str:
    """root/workspace/kind/id, each part checked."""
    for p in parts:
        if not re.fullmatch(r"[A-Za-z0-9_\-.]{1,128}", p) or p.strip(".") == "":
            raise ValueError(f"not a part of a key: {p!r}")
    return reduce(lambda a, b: f"{a}/{b}", parts, root.rstrip("/"))


class Objects:
    """Payloads (workspace, kind, id, payload) in parquet, by workspace and kind: what belongs together lies together."""

    SCHEMA = "workspace string, kind string, id string, payload binary"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, workspace: str, kind: str | None = None) -> str:
        object_path("", workspace, *([kind] if kind else []))
        return f"{self.root}/workspace={workspace}" + (f"/kind={kind}" if kind else "")

    def read(self, workspace: str, kind: str | None = None) -> DataFrame:
        """All payloads of a workspace; a workspace that has none gives none."""
        fs, folder = self._fs(), self._folder(workspace)
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):
            return self.spark.createDataFrame([], self.SCHEMA)
        df = self.spark.read.schema(self.SCHEMA).parquet(self.root).where(F.col("workspace") == workspace)
        return df if kind is None else df.where(F.col("kind") == kind)

    def put(self, payloads: DataFrame) -> None:
        """Write payloads; one with the same key takes the place of the old one. Each (workspace, kind) written is
        replaced as a whole by the file system's rename, so a reader sees the old or the new."""
        new = payloads.select("workspace", "kind", "id", "payload").dropDuplicates(["workspace", "kind", "id"])
        bad = new.where(~F.col("kind").isin(*PAYLOAD_KINDS)).select("kind").limit(1).collect()
        if bad:
            raise ValueError(f"unknown kind of payload {bad[0].kind!r}")
        fs = self._fs()
        if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.root)):
            from veilspark.session import cut

            old = self.spark.read.schema(self.SCHEMA).parquet(self.root)
            touched = old.join(new.select("workspace", "kind").distinct(), ["workspace", "kind"], "left_semi")
            new = cut(touched.join(new.select("workspace", "kind", "id"), ["workspace", "kind", "id"], "left_anti").unionByName(new))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace", "kind").parquet(self.root)

    def delete(self, workspace: str, kind: str, ids: list[str]) -> int:
        """Remove payloads; what is not there is no error. Returns how many there were."""
        from veilspark.session import cut

        have = cut(self.read(workspace, kind))
        there = have.where(F.col("id").isin(*ids)).count() if ids else 0
        if there:
            rest = have.where(~F.col("id").isin(*ids))
            if rest.isEmpty():
                self.delete_prefix(workspace, kind)
            else:
                rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace", "kind").parquet(self.root)
        return there

    def delete_prefix(self, workspace: str, kind: str | None = None) -> bool:
        """Drop all of a workspace, or of one kind of it, without reading any."""
        return self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(workspace, kind)), True)


def upsert(current: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changed`` in place of those with the same keys; the others stay."""
    return current.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed)
