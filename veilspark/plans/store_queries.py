"""Relational queries of the store: scoped look-ups, latest versions, retention, chains, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.operators import asof, intervals, policy, similarity
from veilspark.plans.registry import query, table
from veilspark.sources.files import upsert
from veilspark.session import tuned

W = Window


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` of every key: one hash aggregate, no sort of a key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


@query("""
SELECT record_id, handle, ingested_at FROM (SELECT record_id, handle, ingested_at, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM content_record) r WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "content_record").select("record_id", "handle", "ingested_at"), "record_id", "ingested_at")


@query("""
SELECT w.workspace_id, w.name, CAST(count(DISTINCT c.record_id) AS BIGINT) AS n_records, CAST(coalesce(sum(c.bytes_total), 0) AS BIGINT) AS n_bytes
FROM workspace w JOIN (SELECT record_id, any_value(workspace_id) AS workspace_id, any_value(bytes_total) AS bytes_total FROM content_record GROUP BY record_id) c USING (workspace_id) GROUP BY ALL""")
def workspace_records(spark: SparkSession, sf: str) -> DataFrame:
    """The inner equi-join; records are counted per workspace before the join, so a hot one stays small."""
    one = table(spark, sf, "content_record").groupBy("record_id").agg(F.first("workspace_id").alias("workspace_id"), F.first("bytes_total").alias("bytes_total"))
    per = one.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("bytes_total"), F.lit(0)).alias("n_bytes"))
    return table(spark, sf, "workspace").join(per, "workspace_id").select("workspace_id", "name", "n_records", "n_bytes")


@query("""
SELECT workspace_id, record_id, created_at FROM (
  SELECT workspace_id, record_id, created_at, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, record_id DESC) AS rn
  FROM (SELECT DISTINCT workspace_id, record_id, created_at FROM content_record) c) r WHERE rn <= 50""")
def scoped_list_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 50 records of every workspace; Spark keeps 50 a group on the map side."""
    df = table(spark, sf, "content_record").select("workspace_id", "record_id", "created_at").distinct()
    return df.withColumn("rn", F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("record_id")))).where("rn <= 50").drop("rn")


@query("""
SELECT docket_no, max(version_no) AS version_no, CAST(count(*) AS BIGINT) AS n_versions FROM documents WHERE docket_no IS NOT NULL GROUP BY docket_no""")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("docket_no is not null").groupBy("docket_no").agg(F.max("version_no").alias("version_no"), F.count(F.lit(1)).alias("n_versions"))


@query("""
SELECT s.scan_id, s.record_id, s.requested_at, c.ingested_at AS seen_at FROM (SELECT DISTINCT scan_id, record_id, requested_at FROM scan_options) s
ASOF LEFT JOIN (SELECT record_id, ingested_at FROM content_record) c ON s.record_id = c.record_id AND s.requested_at >= c.ingested_at""")
def content_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Of every scan, when the version of its record that was current at the request had come in."""
    scans = table(spark, sf, "scan_options").select("scan_id", "record_id", "requested_at").distinct()
    versions = table(spark, sf, "content_record").select("record_id", "ingested_at", F.col("ingested_at").alias("seen_at"))
    return asof.latest_before(scans, versions, ["record_id"], "requested_at", "ingested_at", ["seen_at"])


@query("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n_calls, round(sum(value), 4) AS total, bool_or(event_type = 'error') AS ever_error, max(ts) AS last_at FROM events GROUP BY user_id""")
def usage_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that add up and a flag that sticks."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("value"), 4).alias("total"), F.bool_or(F.col("event_type") == "error").alias("ever_error"), F.max("ts").alias("last_at"))


_TYPES = ", ".join(f"('{t}')" for t in lx.SOURCE_TYPES)


@query(f"""
SELECT w.workspace_id, t.kind FROM workspace w, (VALUES {_TYPES}) t(kind) EXCEPT SELECT workspace_id, upper(trim(source_type)) FROM content_record""")
def missing_categories(spark: SparkSession, sf: str) -> DataFrame:
    """What every workspace should have and has not."""
    want = table(spark, sf, "workspace").select("workspace_id", F.explode(F.array(*[F.lit(t) for t in lx.SOURCE_TYPES])).alias("kind"))
    have = table(spark, sf, "content_record").select("workspace_id", F.upper(F.trim("source_type")).alias("kind")).distinct()
    return want.join(have, ["workspace_id", "kind"], "left_anti")


@query("""
SELECT 'field' AS kind, CAST(count(*) AS BIGINT) AS n FROM extracted_field f WHERE NOT EXISTS (SELECT 1 FROM content_record c WHERE c.record_id = f.record_id)
UNION ALL SELECT 'scan', CAST(count(*) AS BIGINT) FROM scan_options s WHERE NOT EXISTS (SELECT 1 FROM content_record c WHERE c.record_id = s.record_id)
UNION ALL SELECT 'sample', CAST(count(*) AS BIGINT) FROM sample_pii s WHERE NOT EXISTS (SELECT 1 FROM content_record c WHERE c.record_id = s.record_id)
UNION ALL SELECT 'record', CAST(count(*) AS BIGINT) FROM content_record c WHERE NOT EXISTS (SELECT 1 FROM workspace w WHERE w.workspace_id = c.workspace_id)""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose parent is gone, by kind."""
    content = table(spark, sf, "content_record")
    ids = content.select("record_id").distinct()
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    out = count(table(spark, sf, "extracted_field").join(ids, "record_id", "left_anti"), "field")
    for kind, name in (("scan", "scan_options"), ("sample", "sample_pii")):
        out = out.unionByName(count(table(spark, sf, name).join(ids, "record_id", "left_anti"), kind))
    return out.unionByName(count(content.join(table(spark, sf, "workspace"), "workspace_id", "left_anti"), "record"))


_RETENTION = {"FILE": 365, "TEXT": 90, "APPLICATION_LOG": 30, "AWS_CLOUDWATCH": 30, "WINDOWS_EVENT_LOG": 180}
_RETENTION_SQL = ", ".join(f"('{k}', {v})" for k, v in _RETENTION.items())


@query(f"""
SELECT workspace_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT record_id, workspace_id, upper(trim(source_type)) AS kind, created_at FROM content_record) c
JOIN (VALUES {_RETENTION_SQL}) p(kind, days) USING (kind) WHERE created_at < TIMESTAMP '2026-09-01 00:00:00' - to_days(days) GROUP BY workspace_id, kind""")
def retention_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Records older than their type's period; one created at the cut-off itself is kept."""
    policies = F.create_map(*[F.lit(x) for kv in _RETENTION.items() for x in kv])
    df = table(spark, sf, "content_record").select("record_id", "workspace_id", F.upper(F.trim("source_type")).alias("kind"), "created_at").distinct()
    cutoff = F.lit("2026-09-01 00:00:00").cast("timestamp") - F.make_interval(days=policies[F.col("kind")])
    return df.where(F.col("created_at") < cutoff).groupBy("workspace_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT record_id, CAST(n_fields AS BIGINT) AS n_fields, CAST(n_scans AS BIGINT) AS n_scans, CAST(1 + n_fields + n_scans AS BIGINT) AS n_rows FROM (
  SELECT c.record_id, coalesce(f.n, 0) AS n_fields, coalesce(s.n, 0) AS n_scans FROM (SELECT DISTINCT record_id FROM content_record) c
  LEFT JOIN (SELECT record_id, count(DISTINCT field_id) AS n FROM extracted_field GROUP BY record_id) f USING (record_id) LEFT JOIN (SELECT record_id, count(DISTINCT scan_id) AS n FROM scan_options GROUP BY record_id) s USING (record_id)) r""")
def cascade_receipt(spark: SparkSession, sf: str) -> DataFrame:
    """What deleting a record takes with it: children counted first, all three sides keyed alike."""
    ids = table(spark, sf, "content_record").select("record_id").distinct()
    fields = table(spark, sf, "extracted_field").groupBy("record_id").agg(F.count_distinct("field_id").alias("n_fields"))
    scans = table(spark, sf, "scan_options").groupBy("record_id").agg(F.count_distinct("scan_id").alias("n_scans"))
    df = ids.join(fields, "record_id", "left").join(scans, "record_id", "left").fillna(0, ["n_fields", "n_scans"])
    return df.withColumn("n_rows", F.lit(1) + F.col("n_fields") + F.col("n_scans"))


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 3600 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session""")
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after an hour without an event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    late = F.col("ts") > before + F.expr("INTERVAL 3600 SECONDS")
    df = table(spark, sf, "events").select("user_id", "ts", "event_id").withColumn("fresh", F.when(before.isNull() | late, 1).otherwise(0))
    df = df.withColumn("session", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT request_id, sample_id, received_at FROM (
  SELECT request_id, sample_id, received_at, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, sample_id DESC) AS rn FROM sample_pii WHERE request_id IS NOT NULL) s WHERE rn = 1
ORDER BY received_at DESC, sample_id DESC LIMIT 10""")
def bounded_results(spark: SparkSession, sf: str) -> DataFrame:
    """The newest result of each request, and of those the newest ten (a report)."""
    df = table(spark, sf, "sample_pii").where("request_id is not null").select("request_id", "sample_id", "received_at")
    one = df.groupBy("request_id").agg(F.max_by(F.struct("sample_id", "received_at"), F.struct("received_at", "sample_id")).alias("r")).select("request_id", "r.*")
    return one.orderBy(F.desc("received_at"), F.desc("sample_id")).limit(10)


@query("""
SELECT record_id, field_id, seq FROM (
  SELECT record_id, field_id, seq, is_key, sum(CAST(is_key AS INTEGER)) OVER (PARTITION BY record_id ORDER BY seq DESC, field_id DESC ROWS UNBOUNDED PRECEDING) AS turns
  FROM (SELECT record_id, field_id, any_value(seq) AS seq, any_value(is_key) AS is_key FROM extracted_field GROUP BY record_id, field_id) f) t WHERE turns <= 12""")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a record's last twelve keys, as a conversation keeps its last turns."""
    df = table(spark, sf, "extracted_field").groupBy("record_id", "field_id").agg(F.first("seq").alias("seq"), F.first("is_key").alias("is_key"))
    w = W.partitionBy("record_id").orderBy(F.desc("seq"), F.desc("field_id")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("turns", F.sum(F.col("is_key").cast("int")).over(w)).where("turns <= 12").select("record_id", "field_id", "seq")


@query("""
SELECT record_id, field_id, CAST(sum(greatest(1, floor(coalesce(length(value), 0) / 4))) OVER (PARTITION BY record_id ORDER BY seq, field_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent
FROM (SELECT record_id, field_id, any_value(seq) AS seq, any_value(value) AS value FROM extracted_field GROUP BY record_id, field_id) f""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens spent up to each field of a record."""
    df = table(spark, sf, "extracted_field").groupBy("record_id", "field_id").agg(F.first("seq").alias("seq"), F.first("value").alias("value"))
    cost = F.greatest(F.lit(1), F.floor(F.coalesce(F.length("value"), F.lit(0)) / 4))
    w = W.partitionBy("record_id").orderBy("seq", "field_id").rowsBetween(W.unboundedPreceding, 0)
    return df.select("record_id", "field_id", F.sum(cost).over(w).alias("spent"))


@query("""
SELECT field_id, value FROM (SELECT DISTINCT field_id, value FROM extracted_field WHERE NOT is_key AND value IS NOT NULL) f
WHERE sha256('salt' || value) NOT IN (SELECT sha256('salt' || payment.card_number) FROM sample_pii WHERE payment.card_number IS NOT NULL)""")
def allowlist_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """Field values that are not on a list of salted digests."""
    digest = lambda c: F.sha2(F.concat(F.lit("salt"), c), 256)
    values = table(spark, sf, "extracted_field").where("not is_key and value is not null").select("field_id", "value").distinct()
    listed = table(spark, sf, "sample_pii").where("payment.card_number is not null").select(digest(F.col("payment.card_number")).alias("d")).distinct()
    return values.withColumn("d", digest(F.col("value"))).join(listed, "d", "left_anti").select("field_id", "value")


_LINES = "(SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS e FROM lineitem WHERE l_quantity >= 1)"


def _under_way(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the days from shipping on that their quantity takes."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").where("l_quantity >= 1").select("l_orderkey", "l_linenumber", day.alias("s"), F.date_add(day, F.col("l_quantity").cast("int")).alias("e"))


@query(f"""
WITH m AS (SELECT l_orderkey, s, e, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_LINES} l),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, min(s) AS s, max(e) AS e FROM i GROUP BY l_orderkey, island""")
def merged_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(_under_way(spark, sf), ["l_orderkey"], "s", "e")


@query(f"""
SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM {_LINES} a JOIN {_LINES} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.s < b.e AND b.s < a.e""")
def interval_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order that are under way at the same time."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    base = _under_way(spark, sf).select("l_orderkey", "l_linenumber", day("s").alias("s"), day("e").alias("e"))
    a = base.select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("s").alias("start_a"), F.col("e").alias("end_a"))
    b = base.select("l_orderkey", F.col("l_linenumber").alias("line_b"), F.col("s").alias("start_b"), F.col("e").alias("end_b"))
    return intervals.overlapping(a, b, ["l_orderkey"], 32).where("line_a < line_b").select("l_orderkey", "line_a", "line_b")


_NEAR = """
SELECT q.vec_id AS query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""


@query(_NEAR)
def vector_topk_exact(spark: SparkSession, sf: str) -> DataFrame:
    """For every hundredth vector its ten nearest among all."""
    vectors = table(tuned(spark), sf, "embeddings")
    return similarity.nearest(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "vec_id", "rank")


def _rule_rows() -> list[tuple]:
    return [(name, r.type, r.action, lx.ACTIONS[r.action], r.threshold, r.span) for name in lx.PROFILES for r in policy.own_rules(name).values()]


_RULES_SQL = ", ".join(f"('{n}', '{t}', '{a}', {p}, {th}, {sp})" for n, t, a, p, th, sp in _rule_rows())


@query(f"""
SELECT type, max_by(action, prio) AS action, min(threshold) AS threshold, max(span) AS span FROM (VALUES {_RULES_SQL}) r(profile, type, action, prio, threshold, span) GROUP BY type""")
def profile_merge(spark: SparkSession, sf: str) -> DataFrame:
    """All profiles together: the strictest action, the lowest threshold, the widest span of every type."""
    rules = spark.createDataFrame(_rule_rows(), "profile string, type string, action string, prio int, threshold double, span int")
    return rules.groupBy("type").agg(F.max_by("action", "prio").alias("action"), F.min("threshold").alias("threshold"), F.max("span").alias("span"))


def _action_rows() -> list[tuple]:
    out = []
    for name in lx.PROFILES:
        p = policy.resolve(name)
        out += [(name, t, r.action, d, r.destinations.get(d)) for t, r in p.rules.items() for d in lx.DESTINATIONS]
    return out


_ACTIONS_SQL = ", ".join("({})".format(", ".join("NULL" if v is None else f"'{v}'" for v in row)) for row in _action_rows())


@query(f"""
SELECT profile, destination, coalesce(override, action) AS action, CAST(count(*) AS BIGINT) AS n FROM (VALUES {_ACTIONS_SQL}) r(profile, type, action, destination, override) GROUP BY ALL""")
def effective_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Actions in force by profile and destination."""
    rules = spark.createDataFrame(_action_rows(), "profile string, type string, action string, destination string, override string")
    return rules.groupBy("profile", "destination", F.coalesce("override", "action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT profile_name, list_sort([d FOR d IN required_detectors IF d NOT IN ('patterns')]) AS missing FROM profile_definition WHERE len([d FOR d IN required_detectors IF d NOT IN ('patterns')]) > 0""")
def detectors_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors that profiles require beyond those there are."""
    missing = F.array_sort(F.array_except("required_detectors", F.array(F.lit("patterns"))))
    return table(spark, sf, "profile_definition").select("profile_name", missing.alias("missing")).where(F.size("missing") > 0)


_INVARIANTS = ("bytes_total", "verified without sanitized", "created after ingested", "handle missing", "negative chunk size", "threshold outside 0..1", "vector length")


@query(f"""
SELECT k.violation, CAST(count(v.violation) AS BIGINT) AS n FROM (VALUES {", ".join(f"('{k}')" for k in _INVARIANTS)}) k(violation) LEFT JOIN (
  SELECT 'bytes_total' AS violation FROM content_record WHERE bytes_total IS NOT NULL AND bytes_total <> coalesce(strlen(content), 0)
  UNION ALL SELECT 'verified without sanitized' FROM content_record WHERE verified_clean AND NOT is_sanitized
  UNION ALL SELECT 'created after ingested' FROM content_record WHERE created_at > ingested_at
  UNION ALL SELECT 'handle missing' FROM content_record WHERE coalesce(length(handle), 0) = 0
  UNION ALL SELECT 'negative chunk size' FROM scan_options WHERE chunk_size < 0
  UNION ALL SELECT 'threshold outside 0..1' FROM scan_options WHERE confidence_threshold NOT BETWEEN 0 AND 1
  UNION ALL SELECT 'vector length' FROM embeddings WHERE len(embedding) <> 64) v USING (violation) GROUP BY k.violation""")
def record_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows break each invariant, 0 included: one pass over each table."""

    def counted(df: DataFrame, **conditions: Column) -> DataFrame:
        one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k.replace("__", "..").replace("_", " ") if k != "bytes_total" else k).alias("violation"), F.col(k).alias("n")) for k in conditions])).alias("x")).select("x.*")

    c = F.col
    of_content = counted(
        table(spark, sf, "content_record"), bytes_total=c("bytes_total").isNotNull() & (c("bytes_total") != F.coalesce(F.octet_length("content"), F.lit(0))), verified_without_sanitized=c("verified_clean") & ~c("is_sanitized"),
        created_after_ingested=c("created_at") > c("ingested_at"), handle_missing=F.coalesce(F.length("handle"), F.lit(0)) == 0,
    )
    of_scans = counted(table(spark, sf, "scan_options"), negative_chunk_size=c("chunk_size") < 0, threshold_outside_0__1=~c("confidence_threshold").between(0, 1))
    return of_content.unionByName(of_scans).unionByName(counted(table(spark, sf, "embeddings"), vector_length=F.size("embedding") != 64))


@query("""
SELECT record_id, ingested_at FROM (SELECT record_id, ingested_at, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM content_record) r WHERE rn = 1""")
def upsert_replays(spark: SparkSession, sf: str) -> DataFrame:
    """First deliveries, with replays put in their place."""
    df = table(spark, sf, "content_record").select("record_id", "ingested_at")
    first = df.groupBy("record_id").agg(F.min("ingested_at").alias("ingested_at"))
    last = df.groupBy("record_id").agg(F.max("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return upsert(first, last, ["record_id"])


@query("""
SELECT handle, source_identifier, created_at FROM (
  SELECT handle, source_identifier, created_at, row_number() OVER (PARTITION BY lower(source_identifier), workspace_id ORDER BY created_at DESC, record_id DESC) AS rn
  FROM (SELECT DISTINCT record_id, workspace_id, handle, source_identifier, created_at, is_sanitized FROM content_record) c WHERE NOT coalesce(is_sanitized, false) AND source_identifier IS NOT NULL) r WHERE rn = 1""")
def newest_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Of every label of a workspace, apart from case, the newest record that is not sanitized."""
    df = table(spark, sf, "content_record").where("not coalesce(is_sanitized, false) and source_identifier is not null")
    best = F.max_by(F.struct("handle", "source_identifier", "created_at"), F.struct("created_at", "record_id"))
    return df.groupBy(F.lower("source_identifier").alias("label"), "workspace_id").agg(best.alias("r")).select("r.*")


@query("""
SELECT scan_id, CASE WHEN dry_run THEN 'reported' WHEN destination IS NULL THEN 'needs destination' ELSE 'finished' END AS status, coalesce(requested_action, 'profile') AS asked
FROM (SELECT scan_id, any_value(dry_run) AS dry_run, any_value(destination) AS destination, any_value(requested_action) AS requested_action FROM scan_options GROUP BY scan_id) s""")
def scan_status(spark: SparkSession, sf: str) -> DataFrame:
    """A guarded update: every scan gets its status from what it was asked."""
    df = table(spark, sf, "scan_options").select("scan_id", "dry_run", "destination", "requested_action").distinct()
    status = F.when(F.col("dry_run"), "reported").when(F.col("destination").isNull(), "needs destination").otherwise("finished")
    return df.select("scan_id", status.alias("status"), F.coalesce("requested_action", F.lit("profile")).alias("asked"))
