"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import credentials, leakage, lookalikes, packing, pii, residue, splitting
from veilspark.session import spread, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = tuned(spark).read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("content_record", "documents") else df


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, sf, "content_record"), table(spark, sf, "extracted_field"))


@query
def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row that looks like a different one, with its class and the class's size."""
    return lookalikes.look_alike_classes(table(spark, sf, "content_record"), table(spark, sf, "extracted_field"))


@query
def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text that is not in it yet."""
    rows = lookalikes.grouped(table(spark, sf, "content_record"), table(spark, sf, "extracted_field"))
    done = lookalikes.consistent(rows.select("src", "key", "text"))
    changed = done.where(F.col("stored") != lookalikes.digest_of(F.col("canonical")))
    return changed.select("src", F.col("key").alias("row_key"), "canonical").dropDuplicates(["src", "row_key"])


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.found(table(spark, sf, "content_record"), table(spark, sf, "sample_pii"))


@query
def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every content that holds a credential, with its credentials redacted."""
    content = table(spark, sf, "content_record").select("record_id", "content")
    return credentials.redacted(content, "content").where("redacted <> content").dropDuplicates(["record_id"]).select("record_id", "redacted")


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "extracted_field")
    return pii.found(table(spark, sf, "content_record"), fields, pii.known_names(table(spark, sf, "name_lexicon"), fields))


@query
def p2_scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that names a person or how to reach one, with placeholders instead."""
    content, fields = table(spark, sf, "content_record"), table(spark, sf, "extracted_field")
    names = pii.known_names(table(spark, sf, "name_lexicon"), fields)
    texts = content.select(F.lit("content").alias("src"), F.col("record_id").alias("row_key"), F.col("content").alias("text"), F.lit("").alias("path")).unionByName(
        fields.select(F.lit("field"), "field_id", "value", pii.value_path()).toDF("src", "row_key", "text", "path")
    )
    return pii.scrubbed(texts, "text", names, "path").where("scrubbed <> text").dropDuplicates(["src", "row_key"]).select("src", "row_key", "scrubbed")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(table(spark, sf, "content_record"), table(spark, sf, "scan_options"), table(spark, sf, "profile_definition"))


ORACLE["p5_found"] = """
WITH RECURSIVE up(root, name) AS (
    SELECT profile_name, profile_name FROM profile_definition
    UNION
    SELECT up.root, u.parent FROM up JOIN (SELECT profile_name, unnest(inherits) AS parent FROM profile_definition) u ON u.profile_name = up.name
), spans AS (
    SELECT up.root AS name, max(p.max_pattern_span) AS span FROM up JOIN profile_definition p ON p.profile_name = up.name GROUP BY up.root
), named AS (
    SELECT s.scan_id, max(coalesce(spans.span, 0)) AS span
    FROM (SELECT scan_id, unnest(CASE WHEN len(profile_names) > 0 THEN profile_names ELSE [NULL] END) AS name FROM scan_options) s LEFT JOIN spans USING (name) GROUP BY s.scan_id
), limits AS (
    SELECT DISTINCT s.scan_id, s.record_id, greatest(CASE WHEN coalesce(s.chunk_size, 0) > 0 THEN s.chunk_size ELSE 8192 END, 4 * greatest(4096, CAST(floor(n.span * 1.25) AS INTEGER))) AS size
    FROM scan_options s JOIN named n USING (scan_id)
)
SELECT DISTINCT l.scan_id, l.record_id FROM limits l JOIN content_record c USING (record_id) WHERE length(c.content) > l.size
"""


@query
def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized record, once for all scans of the same size and overlap."""
    return splitting.split_scans(table(spark, sf, "content_record"), table(spark, sf, "scan_options"), table(spark, sf, "profile_definition"))[0]


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.found(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(table(spark, sf, "documents"))


@query
def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every text with its container, for every container class."""
    return packing.pack(packing.sizes(table(spark, sf, "documents")), table(spark, sf, "container_spec"))
