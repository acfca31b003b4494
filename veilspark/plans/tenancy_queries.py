"""Queries of the store over tables derived from the given ones: users, members, runs, chunks, sessions, policies.

Customers are users, orders make them members of workspaces and are runs; order lines are tool invocations;
events are sessions and audit rows; extracted fields are chunks. Both the DataFrames and the SQL derive them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators import store
from veilspark.plans.registry import query, table
from veilspark.plans.text_queries import transcript_sql
from veilspark.session import tuned

ROLES = ("reader", "author", "approver", "admin")
NOW = "2026-09-01 00:00:00"

_WS = "ws AS (SELECT workspace_id, name, created_at, row_number() OVER (ORDER BY workspace_id) - 1 AS i FROM workspace)"
_ROLE_LIST = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"
_MEMBERS = f"""{_WS}, membership AS (SELECT w.workspace_id, o.o_custkey AS user_id, {_ROLE_LIST}[1 + CAST(min(o.o_orderkey % 4) AS INTEGER)] AS role
  FROM orders o JOIN ws w ON w.i = o.o_orderkey % 60 GROUP BY w.workspace_id, o.o_custkey)"""


def numbered_workspaces(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed table of workspaces with a number each."""
    return table(spark, sf, "workspace").withColumn("i", F.row_number().over(Window.orderBy("workspace_id")) - 1)


def membership(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 60).alias("i"), (F.col("o_orderkey") % 4).alias("r"))
    per = orders.groupBy("i", F.col("o_custkey").alias("user_id")).agg(F.min("r").alias("r"))
    roles = F.array(*[F.lit(r) for r in ROLES])
    return per.join(numbered_workspaces(spark, sf).select("i", "workspace_id"), "i").select("workspace_id", "user_id", F.element_at(roles, (F.col("r") + 1).cast("int")).alias("role"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@Example.com")).alias("email"), (F.col("c_acctbal") < 0).alias("disabled"))


@query(f"WITH {_MEMBERS} SELECT m.user_id, w.workspace_id, w.name, m.role FROM ws w JOIN membership m USING (workspace_id) WHERE m.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def workspaces_for_users(spark: SparkSession, sf: str) -> DataFrame:
    """The workspaces of all users whose account is disabled."""
    asked = users(spark, sf).where("disabled")
    return store.workspaces_for(table(spark, sf, "workspace"), membership(spark, sf), asked).select("user_id", "workspace_id", "name", "role")


@query("SELECT c_custkey AS user_id, c_name || '@Example.com' AS email FROM customer WHERE lower(c_name || '@Example.com') = lower('CUSTOMER#000000042@EXAMPLE.COM')")
def user_by_email(spark: SparkSession, sf: str) -> DataFrame:
    return store.user_by_email(users(spark, sf), "CUSTOMER#000000042@EXAMPLE.COM").select("user_id", "email")


@query(f"WITH {_MEMBERS} SELECT workspace_id, role, CAST(count(*) AS BIGINT) AS n FROM membership GROUP BY workspace_id, role")
def members_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return membership(spark, sf).groupBy("workspace_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_MEMBERS}, added AS (SELECT DISTINCT w.workspace_id, o.o_custkey AS user_id FROM orders o JOIN ws w ON w.i = o.o_custkey % 60 WHERE o.o_orderstatus = 'P'),
after AS (SELECT workspace_id, user_id, role FROM membership m WHERE NOT EXISTS (SELECT 1 FROM added a WHERE a.workspace_id = m.workspace_id AND a.user_id = m.user_id) UNION ALL SELECT workspace_id, user_id, 'admin' FROM added)
SELECT role, CAST(count(*) AS BIGINT) AS n FROM after GROUP BY role""")
def member_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The roles after some users were made administrators of one more workspace."""
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 60).alias("i")).distinct()
    new = new.join(numbered_workspaces(spark, sf).select("i", "workspace_id"), "i").select("workspace_id", "user_id", F.lit("admin").alias("role"))
    return store.add_member(membership(spark, sf), new).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_GRANT_ROWS = ", ".join(f"('{r}', '{c}')" for r, cs in store.GRANTS.items() for c in cs)


@query(f"""
WITH {_MEMBERS} SELECT g.capability, CAST(count(*) AS BIGINT) AS n FROM membership m JOIN (VALUES {_GRANT_ROWS}) g(role, capability) ON g.role = m.role GROUP BY g.capability""")
def capability_holders(spark: SparkSession, sf: str) -> DataFrame:
    """How many memberships hold each capability; no role implies another."""
    held = F.filter(F.array(*[F.when(store.permitted(F.col("role"), c), F.lit(c)) for c in store.CAPABILITIES]), lambda c: c.isNotNull())
    return membership(spark, sf).select(F.explode(held).alias("capability")).groupBy("capability").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_MEMBERS}, asks AS (SELECT o.o_orderkey, o.o_custkey AS user_id, w.workspace_id FROM orders o JOIN ws w ON w.i = (o.o_orderkey + o.o_custkey) % 60)
SELECT CASE WHEN m.role IS NULL THEN 'not found' WHEN m.role IN ('approver', 'admin') THEN 'granted' ELSE 'not permitted' END AS answer, CAST(count(*) AS BIGINT) AS n
FROM asks a LEFT JOIN membership m ON m.workspace_id = a.workspace_id AND m.user_id = a.user_id GROUP BY 1""")
def authorized_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Who may approve where: to a non-member the workspace does not exist."""
    asks = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), ((F.col("o_orderkey") + F.col("o_custkey")) % 60).alias("i"))
    asks = asks.join(numbered_workspaces(spark, sf).select("i", "workspace_id"), "i")
    answer = F.when(F.col("role").isNull(), "not found").when(store.permitted(F.col("role"), "approve"), "granted").otherwise("not permitted")
    return asks.join(membership(spark, sf), ["workspace_id", "user_id"], "left").groupBy(answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT record_id, created_at FROM (SELECT DISTINCT record_id, created_at, workspace_id FROM content_record) c WHERE workspace_id = (SELECT min(workspace_id) FROM workspace) ORDER BY created_at DESC, record_id DESC LIMIT 50""")
def scoped_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest fifty records that one workspace sees; the predicate reaches the scan."""
    first = table(spark, sf, "workspace").agg(F.min("workspace_id")).first()[0]
    tables = {"content_record": table(spark, sf, "content_record").select("workspace_id", "record_id", "created_at").distinct()}
    return store.Store(tables).scope(first).newest("content_record", "created_at", "record_id").select("record_id", "created_at")


_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status FROM orders)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(done, "completed").otherwise("running").alias("status"), F.when(done, "answered").alias("completion_reason"), F.when(done, F.col("o_orderdate")).alias("finished_at")
    )


@query(f"""
WITH {_RUNS}, ends AS (SELECT l_orderkey AS run_id, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
after AS (SELECT CASE WHEN r.status = 'running' AND e.run_id IS NOT NULL AND e.q >= 10 THEN 'failed' ELSE r.status END AS status FROM runs r LEFT JOIN ends e USING (run_id))
SELECT 'table' AS side, status AS what, CAST(count(*) AS BIGINT) AS n FROM after GROUP BY status
UNION ALL SELECT 'refused', CASE WHEN r.status <> 'running' THEN 'already finished' ELSE 'no reason or end' END, CAST(count(*) AS BIGINT) FROM ends e JOIN runs r USING (run_id) WHERE r.status <> 'running' OR e.q < 10 GROUP BY 2""")
def finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs ended once: what is already finished, or has no reason, is refused and stays as it is."""
    ends = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("finished_at"))
    ends = ends.select("run_id", F.lit("failed").alias("status"), F.when(F.col("q") >= 10, "budget").alias("completion_reason"), "finished_at")
    done = store.finish_runs(runs(spark, sf), ends)
    count = lambda df, side, what: df.groupBy(F.col(what).alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "what", "n")
    return count(done.table, "table", "status").unionByName(count(done.refused, "refused", "why"))


@query("""
WITH chunks AS (SELECT DISTINCT record_id, field_id FROM extracted_field), docs AS (SELECT DISTINCT record_id FROM sample_pii WHERE record_id IS NOT NULL)
SELECT record_id AS document_id, CAST(count(*) AS BIGINT) AS n_chunks FROM chunks WHERE record_id NOT IN (SELECT record_id FROM docs) GROUP BY record_id
UNION ALL SELECT record_id, 2 FROM docs""")
def replaced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of every document after those of some were replaced by two each."""
    f = table(spark, sf, "extracted_field").select("record_id", "field_id").distinct()
    chunks = f.select(F.col("record_id").alias("document_id"), F.col("field_id").alias("sequence"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    docs = table(spark, sf, "sample_pii").where("record_id is not null").select(F.col("record_id").alias("document_id")).distinct()
    new = docs.select("document_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("sequence")).withColumn("start_offset", F.lit(0)).withColumn("end_offset", F.lit(10))
    return store.replace_chunks(chunks, new).table.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("""
WITH numbered AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
SELECT user_id AS run_id, CAST(count(*) AS BIGINT) AS n_events, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_errors, CAST(max(seq) AS BIGINT) AS last_sequence FROM numbered GROUP BY user_id""")
def appended_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Trace events by run after errors were appended, some of them twice: a sequence number is taken once."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).alias("sequence"), "event_type")
    new = e.where("event_type = 'error'")
    done = store.append_once(e.where("event_type <> 'error'"), new.unionByName(new), ["run_id", "sequence"]).table
    return done.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max("sequence").cast("bigint").alias("last_sequence"))


@query("""
SELECT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS sequence, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS place FROM lineitem
WHERE l_quantity > 40 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def awaiting_approval(spark: SparkSession, sf: str) -> DataFrame:
    """Tool invocations that need an approval and have none, in the order of their runs."""
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("invocation_id"), F.col("l_linenumber").cast("int").alias("sequence"), (F.col("l_quantity") > 40).alias("requires_approval"))
    approved = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("invocation_id"))
    w = Window.partitionBy("invocation_id").orderBy("sequence")
    return store.awaiting_approval(calls, approved).select(F.col("invocation_id").alias("run_id"), "sequence", F.row_number().over(w).alias("place"))


_SESSIONS = """sessions AS (SELECT event_id, user_id, ts AS created_at, ts + INTERVAL 12 HOUR AS expires_at, ts + to_minutes(CAST(floor(value * 10) AS INTEGER)) AS last_seen_at,
  CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR END AS revoked_at FROM events), clock AS (SELECT max(ts) AS now FROM events)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.col("ts")
    return e.select(
        "event_id", "user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("token_sha256"), ts.alias("created_at"), (ts + F.expr("INTERVAL 12 HOURS")).alias("expires_at"),
        (ts + F.make_interval(mins=F.floor(F.col("value") * 10).cast("int"))).alias("last_seen_at"), F.when(F.col("event_type") == "error", ts + F.expr("INTERVAL 1 HOUR")).alias("revoked_at"),
    )


@query(f"""
WITH {_SESSIONS} SELECT CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN NOT now < expires_at THEN 'expired' WHEN NOT now < last_seen_at + INTERVAL 3600 SECOND THEN 'idle' ELSE 'usable' END AS state, CAST(count(*) AS BIGINT) AS n
FROM sessions, clock GROUP BY 1""")
def session_states(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by why they can or cannot be used at the table's last moment."""
    s = sessions(spark, sf)
    now = F.lit(s.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    state = F.when(store.usable(now), "usable").when(F.col("revoked_at").isNotNull(), "revoked").when(~(now < F.col("expires_at")), "expired").otherwise("idle")
    return s.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_SESSIONS}, after AS (SELECT s.user_id, CASE WHEN s.revoked_at IS NULL AND s.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN TIMESTAMP '{NOW}' ELSE s.revoked_at END AS revoked_at FROM sessions s)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE revoked_at = TIMESTAMP '{NOW}') AS BIGINT) AS n_now, CAST(count(*) FILTER (WHERE revoked_at IS NULL) AS BIGINT) AS n_live FROM after GROUP BY user_id""")
def revoked_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions of disabled users revoked; what was revoked before keeps its time."""
    off = users(spark, sf).where("disabled").select("user_id", F.lit(True).alias("off"))
    at = F.lit(NOW).cast("timestamp_ntz")
    s = store.revoke(sessions(spark, sf).join(off, "user_id", "left"), F.coalesce(F.col("off"), F.lit(False)), at)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("revoked_at") == at).alias("n_now"), F.count_if(F.col("revoked_at").isNull()).alias("n_live"))


_POLICY_ROWS = ", ".join(f"('{c}')" for c in store.RETENTION_REQUIRED)
_POLICIES = f"""{_WS}, policies AS (SELECT w.workspace_id, c.category, 60 + 10 * (w.i % 9) AS days FROM ws w, (VALUES {_POLICY_ROWS}) c(category) WHERE NOT (c.category = 'session' AND w.i % 7 = 3)),
whole AS (SELECT workspace_id, max(days) FILTER (WHERE category = 'document') AS days FROM policies GROUP BY workspace_id HAVING count(*) = {len(store.RETENTION_REQUIRED)})"""


def policies(spark: SparkSession, sf: str) -> DataFrame:
    """Periods by workspace and category; some workspaces have none for sessions."""
    rows = numbered_workspaces(spark, sf).select("workspace_id", "i", F.explode(F.array(*[F.lit(c) for c in store.RETENTION_REQUIRED])).alias("category"))
    return rows.where(~((F.col("category") == "session") & (F.col("i") % 7 == 3))).select("workspace_id", "category", (F.lit(60) + 10 * (F.col("i") % 9)).alias("retention_days"))


@query(f"""
WITH {_POLICIES}, r AS (SELECT DISTINCT record_id, workspace_id, created_at FROM content_record)
SELECT r.workspace_id, CAST(count(*) FILTER (WHERE w.days IS NULL OR NOT r.created_at < TIMESTAMPTZ '{NOW}+00' - to_days(CAST(w.days AS INTEGER)) OR r.created_at IS NULL) AS BIGINT) AS n_kept,
       CAST(count(*) FILTER (WHERE w.days IS NOT NULL AND r.created_at < TIMESTAMPTZ '{NOW}+00' - to_days(CAST(w.days AS INTEGER))) AS BIGINT) AS n_deleted, bool_or(w.workspace_id IS NULL) AS skipped
FROM r LEFT JOIN whole w ON w.workspace_id = r.workspace_id WHERE r.workspace_id IS NOT NULL GROUP BY r.workspace_id""")
def retention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What a sweep keeps and deletes by workspace; one without all its periods is left alone as a whole."""
    rows = table(spark, sf, "content_record").select("record_id", "workspace_id", "created_at").where("workspace_id is not null").distinct()
    done = store.sweep(rows, table(spark, sf, "workspace").select("workspace_id"), policies(spark, sf), "document", "created_at", F.lit(NOW).cast("timestamp"))
    marked = done.kept.select("workspace_id", F.lit(1).alias("k"), F.lit(0).alias("d")).unionByName(done.deleted.select("workspace_id", F.lit(0).alias("k"), F.lit(1).alias("d")))
    per = marked.groupBy("workspace_id").agg(F.sum("k").alias("n_kept"), F.sum("d").alias("n_deleted"))
    return per.join(done.skipped.select("workspace_id", F.lit(True).alias("s")), "workspace_id", "left").select("workspace_id", "n_kept", "n_deleted", F.coalesce("s", F.lit(False)).alias("skipped"))


@query(f"WITH {_POLICIES} SELECT w.workspace_id, c.category FROM ws w, (VALUES {_POLICY_ROWS}) c(category) EXCEPT SELECT workspace_id, category FROM policies")
def missing_policies(spark: SparkSession, sf: str) -> DataFrame:
    return store.missing_policies(table(spark, sf, "workspace"), policies(spark, sf))


_DOOMED = "doomed AS (SELECT DISTINCT record_id FROM sample_pii WHERE record_id IS NOT NULL)"
_STUCK = "stuck AS (SELECT DISTINCT record_id FROM sample_pii WHERE record_id IS NOT NULL AND payment.card_number IS NULL)"


def _cascade(spark: SparkSession, sf: str) -> store.Cascade:
    tables = {
        "record": table(spark, sf, "content_record").select("record_id").where("record_id is not null").distinct(),
        "field": table(spark, sf, "extracted_field").select("record_id", "field_id").distinct(),
        "scan": table(spark, sf, "scan_options").select("record_id", "scan_id").distinct(),
    }
    samples = table(spark, sf, "sample_pii")
    return store.delete_cascade(tables, "record", "record_id", samples, samples.where("payment.card_number is null and record_id is not null"))


@query(f"""
WITH {_DOOMED}, {_STUCK}, c AS (SELECT d.record_id, (SELECT count(DISTINCT x.record_id) FROM content_record x WHERE x.record_id = d.record_id) AS r, (SELECT count(DISTINCT f.field_id) FROM extracted_field f WHERE f.record_id = d.record_id) AS f,
  (SELECT count(DISTINCT s.scan_id) FROM scan_options s WHERE s.record_id = d.record_id) AS s, d.record_id NOT IN (SELECT record_id FROM stuck) AS complete FROM doomed d)
SELECT record_id, CAST(CASE WHEN complete THEN r ELSE 0 END AS BIGINT) AS n_record, CAST(CASE WHEN complete THEN f ELSE 0 END AS BIGINT) AS n_field, CAST(CASE WHEN complete THEN s ELSE 0 END AS BIGINT) AS n_scan,
  CAST(CASE WHEN complete THEN r + f + s ELSE 0 END AS BIGINT) AS rows_deleted, complete, r > 0 AS was_there FROM c""")
def deletion_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of a cascade; records whose payload cannot be removed keep their rows."""
    return _cascade(spark, sf).receipt


@query(f"""
WITH {_DOOMED}, {_STUCK}, gone AS (SELECT record_id FROM doomed WHERE record_id NOT IN (SELECT record_id FROM stuck))
SELECT 'record' AS kind, CAST(count(DISTINCT record_id) AS BIGINT) AS n FROM content_record WHERE record_id NOT IN (SELECT record_id FROM gone)
UNION ALL SELECT 'field', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT record_id, field_id FROM extracted_field) f WHERE record_id NOT IN (SELECT record_id FROM gone)
UNION ALL SELECT 'scan', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT record_id, scan_id FROM scan_options) s WHERE record_id NOT IN (SELECT record_id FROM gone)""")
def after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """What the tables hold after the cascade."""
    out = None
    for kind, df in _cascade(spark, sf).tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""
WITH RECURSIVE rows AS (SELECT user_id, event_id, concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR)) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
chain AS (SELECT user_id, event_id, n, repeat('0', 64) AS prev_hash, sha256(payload || '|' || repeat('0', 64)) AS record_hash FROM rows WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, c.record_hash, sha256(r.payload || '|' || c.record_hash) FROM chain c JOIN rows r ON r.user_id = c.user_id AND r.n = c.n + 1)
SELECT user_id, event_id, prev_hash, record_hash FROM chain""")
def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Events as audit rows of their user: each record's hash covers the hash before it."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("payload"))
    return store.linked(rows, "user_id", ["ts", "event_id"], "payload").select("user_id", "event_id", "prev_hash", "record_hash")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def audit_types(spark: SparkSession, sf: str) -> DataFrame:
    return store.records_of_type(table(spark, sf, "events"), "event_type")


@query("""
SELECT * FROM (VALUES ('configuration', 'indefinite', 7), ('content', 'follows_source', 2), ('content', 'policy_per_workspace', 3), ('derived_metadata', 'follows_source', 2),
  ('derived_metadata', 'indefinite', 1), ('derived_metadata', 'survives_deletion', 1), ('telemetry', 'policy_per_workspace', 2)) t(class, ends, n)""")
def data_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of stored data by class and by what ends their life."""
    rows = spark.createDataFrame([(name, *of) for name, of in store.CATEGORIES.items()], "category string, class string, store string, ends string")
    return rows.groupBy("class", "ends").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""
WITH r AS (SELECT record_id, any_value(workspace_id) AS workspace_id, lower(any_value(source_identifier)) AS l, upper(trim(any_value(source_type))) AS kind, any_value(created_at) AS seen FROM content_record GROUP BY record_id),
q AS (SELECT w.workspace_id AS ref_id, w.workspace_id, x.said, x.kind_hint FROM workspace w, (VALUES ('log', 'FILE')) x(said, kind_hint)),
m AS (SELECT q.ref_id, r.record_id, r.seen, CASE WHEN contains(r.l, q.said) THEN 2 WHEN r.kind = q.kind_hint THEN 1 ELSE 0 END AS rk FROM q JOIN r USING (workspace_id))
SELECT ref_id, record_id, rk AS "by" FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rk DESC, seen DESC NULLS LAST, record_id DESC) AS n FROM m) x WHERE n = 1""")
def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """In every workspace, the record that 'the log' means."""
    c = table(spark, sf, "content_record").groupBy("record_id").agg(F.first("workspace_id").alias("workspace_id"), F.first("source_identifier").alias("label"), F.upper(F.trim(F.first("source_type"))).alias("kind"), F.first("created_at").alias("at"))
    asked = table(spark, sf, "workspace").select(F.col("workspace_id").alias("ref_id"), "workspace_id", F.lit("log").alias("said"), F.lit("FILE").alias("kind_hint"))
    return store.resolve_reference(c, asked)


@query(f"""
WITH f AS (SELECT record_id, field_id, any_value(seq) AS seq, any_value(value) AS value, CASE WHEN any_value(is_key) THEN 'user' WHEN any_value(path) LIKE '%id' THEN 'system' ELSE 'assistant' END AS role FROM extracted_field GROUP BY record_id, field_id),
t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY seq DESC, field_id DESC ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT record_id, field_id, role, CASE WHEN n = 0 OR (n = 1 AND role = 'user') THEN value ELSE {transcript_sql("value")} END AS value FROM t WHERE n <= 12 OR role = 'system'""")
def conversation_window(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a record as the turns of a conversation: what of it a model sees."""
    f = table(tuned(spark), sf, "extracted_field").groupBy("record_id", "field_id").agg(F.first("seq").alias("seq"), F.first("value").alias("value"), F.first("is_key").alias("is_key"), F.first("path").alias("path"))
    role = F.when(F.col("is_key"), "user").when(F.col("path").like("%id"), "system").otherwise("assistant")
    turns = f.select("record_id", "field_id", "seq", "value", role.alias("role"))
    return store.conversation_window(turns, "record_id", ["seq", "field_id"], "role", "value").select("record_id", "field_id", "role", "value")


@query("SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(min(len(embedding)) AS INTEGER) AS dimensions FROM embeddings GROUP BY label")
def embedding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dimensions"))


@query("""
WITH w AS (SELECT min(workspace_id) AS workspace_id FROM workspace), c AS (SELECT DISTINCT record_id, workspace_id, content FROM content_record WHERE content IS NOT NULL)
SELECT record_id FROM c JOIN w USING (workspace_id) WHERE sha256(content) = (SELECT sha256(c2.content) FROM c c2 JOIN w USING (workspace_id) ORDER BY c2.record_id LIMIT 1)""")
def found_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    """In one workspace, the records with the content of its first one, by digest."""
    first = table(spark, sf, "workspace").agg(F.min("workspace_id")).first()[0]
    rows = table(spark, sf, "content_record").where("content is not null").select("workspace_id", "record_id", "content").distinct()
    scope = store.Store({"content_record": rows}).scope(first)
    digest = scope.table("content_record").orderBy("record_id").limit(1).select(F.sha2("content", 256)).first()[0]
    return scope.find_by_digest("content_record", "content", digest).select("record_id")


@query("""
SELECT field_id, start_pos, line FROM (
  SELECT field_id, strpos(value, '@') - 1 AS start_pos, list_last(string_split(left(value, strpos(value, '@') - 1), chr(10))) || '@' || string_split(substr(value, strpos(value, '@') + 1), chr(10))[1] AS line
  FROM (SELECT DISTINCT field_id, value FROM extracted_field WHERE contains(value, '@')) f) x""")
def line_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The line around the first at-sign of every value."""
    from veilspark.operators.chunks import line_column

    f = table(spark, sf, "extracted_field").where(F.contains("value", F.lit("@"))).select("field_id", "value").distinct()
    at = F.locate("@", "value") - 1
    return f.select("field_id", at.cast("bigint").alias("start_pos"), line_column(F.col("value"), at, at + 1).alias("line"))
