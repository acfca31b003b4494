"""Queries on texts that SQL can say as well: spans, checksums, rewriting, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.functions import text as fx
from veilspark.operators import injection
from veilspark.operators import normalize as nz
from veilspark.plans.registry import query, table, texts

#: Patterns that Java and RE2 read alike (ASCII classes, no look-around).
#: Every repetition is bounded: without that a long run of letters takes quadratic time.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
URI = r"[a-z][a-z0-9+]{1,15}://[^ \t\r\n\"'<>]+"
AWS_KEY = r"AKIA[A-Z0-9]{16}"
SECRET_KV = r"(?i:password|passwd|api_key|secret|token)[ \t]?[=:][ \t]?[^ \t\r\n\"',;]+"
PEM = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"


def _q(s: str) -> str:
    return s.replace("'", "''")


RECORDS = "(SELECT record_id, any_value(content) AS content FROM content_record WHERE content IS NOT NULL GROUP BY record_id)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with content once; replays are the same."""
    return texts(spark, sf, "content_record").where("content is not null").select("record_id", "content")


def _spans_sql(source: str, key: str, text: str, pattern: str) -> str:
    p = _q(pattern)
    return f"""
WITH r AS (SELECT {key}, {text} AS t, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS s FROM {source} x WHERE regexp_matches({text}, '{p}')),
e AS (SELECT {key}, m, s, unnest(range(1, len(m) + 1)) AS i FROM r)
SELECT {key}, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_pos,
       CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS end_pos, m[i] AS value
FROM e"""


def _span_query(name: str, pattern: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fx.spans(records(spark, sf), "content", pattern, "record_id").distinct()

    run.__name__ = name
    query(_spans_sql(RECORDS, "record_id", "content", pattern))(run)


for _name, _pattern in (("spans_email", EMAIL), ("spans_ipv4", IPV4), ("spans_uri", URI), ("spans_aws_key", AWS_KEY), ("spans_private_key", PEM), ("spans_ssn", SSN)):
    _span_query(_name, _pattern)


@query(f"""
SELECT record_id, CAST(len(regexp_extract_all(content, '{_q(SECRET_KV)}')) AS BIGINT) AS n FROM {RECORDS} r WHERE regexp_matches(content, '{_q(SECRET_KV)}')""")
def secret_assignments(spark: SparkSession, sf: str) -> DataFrame:
    df = records(spark, sf).withColumn("n", F.regexp_count("content", F.lit(SECRET_KV)).cast("bigint")).where("n > 0")
    return df.select("record_id", "n").distinct()


_BREAKDOWN = (("EMAIL_ADDRESS", EMAIL), ("IP_ADDRESS", IPV4), ("AWS_ACCESS_KEY", AWS_KEY), ("PRIVATE_KEY", PEM), ("US_SSN", SSN), ("URL", URI))


def _breakdown_sql(source: str, text: str, by: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {by}, '{k}' AS type, '{lx.severity(k)}' AS severity, CAST(len(regexp_extract_all({text}, '{_q(p)}')) AS BIGINT) AS c FROM {source} x" for k, p in _BREAKDOWN)
    return f"SELECT {by}, type, severity, CAST(sum(c) AS BIGINT) AS n FROM ({parts}) u WHERE c > 0 GROUP BY ALL"


def _breakdown(df: DataFrame, text: str, by: str) -> DataFrame:
    """Occurrences by type in one pass over the texts: all counts of a row, then one partial aggregate."""
    counts = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(lx.severity(k)).alias("severity"), F.regexp_count(text, F.lit(p)).cast("bigint").alias("c")) for k, p in _BREAKDOWN])
    return df.select(by, F.explode(F.filter(counts, lambda x: x["c"] > 0)).alias("x")).groupBy(by, F.col("x.type").alias("type"), F.col("x.severity").alias("severity")).agg(F.sum("x.c").alias("n"))


@query(_breakdown_sql("(SELECT workspace_id, value FROM extracted_field WHERE value IS NOT NULL)", "value", "workspace_id"))
def entity_breakdown_by_workspace(spark: SparkSession, sf: str) -> DataFrame:
    """Entities in the values of all fields, by workspace."""
    return _breakdown(table(spark, sf, "extracted_field").where("value is not null").select("workspace_id", "value"), "value", "workspace_id")


@query(_breakdown_sql("(SELECT upper(trim(source_type)) AS kind, content FROM content_record)", "content", "kind"))
def entity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    df = texts(spark, sf, "content_record").where("content is not null").select(F.upper(F.trim("source_type")).alias("kind"), "content")
    return _breakdown(df, "content", "kind")


@query(f"""
SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM ({_breakdown_sql("(SELECT upper(trim(source_type)) AS kind, content FROM content_record)", "content", "kind")}) b GROUP BY severity""")
def severity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return entity_breakdown(spark, sf).groupBy("severity").agg(F.sum("n").alias("n"))


def _luhn_sql(expr: str) -> str:
    return f"""list_sum(list_transform(range(1, length({expr}) + 1), lambda i: CASE WHEN (length({expr}) - i) % 2 = 0 THEN CAST(substr({expr}, i, 1) AS INTEGER)
        ELSE CAST(substr({expr}, i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr({expr}, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


@query(f"""
SELECT sample_id, coalesce(length(d) BETWEEN 13 AND 19 AND replace(d, left(d, 1), '') <> '' AND {_luhn_sql('d')}, false) AS valid
FROM (SELECT sample_id, any_value(regexp_replace(payment.card_number, '[^0-9]', '', 'g')) AS d FROM sample_pii GROUP BY sample_id) s WHERE d IS NOT NULL""")
def card_luhn(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "sample_pii").where("payment.card_number is not null").select("sample_id", F.col("payment.card_number").alias("c")).dropDuplicates(["sample_id"])
    return df.select("sample_id", F.coalesce(fx.luhn_ok(F.col("c")), F.lit(False)).alias("valid"))


@query("""
SELECT valid, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT d <> '000000000' AND (3 * CAST(d[1] AS INTEGER) + 7 * CAST(d[2] AS INTEGER) + CAST(d[3] AS INTEGER) + 3 * CAST(d[4] AS INTEGER) + 7 * CAST(d[5] AS INTEGER) + CAST(d[6] AS INTEGER)
    + 3 * CAST(d[7] AS INTEGER) + 7 * CAST(d[8] AS INTEGER) + CAST(d[9] AS INTEGER)) % 10 = 0 AS valid
  FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS d FROM orders) o) v GROUP BY valid""")
def aba_checksum(spark: SparkSession, sf: str) -> DataFrame:
    d = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    return table(spark, sf, "orders").select(fx.aba_ok(d).alias("valid")).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT field_id, path, CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) END AS preview
FROM (SELECT field_id, any_value(path) AS path, any_value(value) AS value FROM extracted_field WHERE NOT is_key AND value IS NOT NULL GROUP BY field_id) f""")
def masked_preview(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "extracted_field").where("not is_key and value is not null").select("field_id", "path", fx.preview(F.col("value"), F.lit("PERSON"), F.lit("MEDIUM")).alias("preview"))
    return df.dropDuplicates(["field_id"])


@query(f"""
SELECT record_id, md5(regexp_replace(regexp_replace(content, '{_q(EMAIL)}', '[EMAIL_ADDRESS]', 'g'), '{_q(SSN)}', '[REDACTED:US_SSN]', 'g')) AS digest,
       CAST(length(regexp_replace(content, '{_q(EMAIL)}', '[EMAIL_ADDRESS]', 'g')) - length(content) AS INTEGER) AS grown FROM {RECORDS} r""")
def redact_simple(spark: SparkSession, sf: str) -> DataFrame:
    mail = F.regexp_replace("content", EMAIL, "[EMAIL_ADDRESS]")
    return records(spark, sf).select("record_id", F.md5(F.regexp_replace(mail, SSN, "[REDACTED:US_SSN]")).alias("digest"), (F.length(mail) - F.length("content")).alias("grown")).distinct()


_FROM, _TO = "".join(nz.FOLDS), "".join(nz.FOLDS.values())


@query(f"""
SELECT record_id, CAST(length(content) - length(translate(content, '{lx.INVISIBLE}', '')) AS INTEGER) AS invisible, CAST(length(content) - length(translate(content, '{_FROM}', '')) AS INTEGER) AS homoglyphs,
       md5(translate(content, '{_FROM}{lx.INVISIBLE}', '{_TO}')) AS normalized FROM {RECORDS} r""")
def evasion_signals(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    # ASCII texts are as they are; only the others are walked through
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return records(spark, sf).select(
        "record_id", F.when(plain, 0).otherwise(nz.invisible_count(c)).alias("invisible"), F.when(plain, 0).otherwise(nz.homoglyph_count(c)).alias("homoglyphs"), F.md5(F.when(plain, c).otherwise(nz.normalized_column(c))).alias("normalized")
    ).distinct()


_ROLE = r"(?im)^[ \t]{0,8}(?:system|assistant|user|human|ai)[ \t]{0,4}:"


@query(f"""
SELECT record_id, CAST(len(regexp_extract_all(content, '{_q(_ROLE)}')) AS INTEGER) AS n FROM {RECORDS} r WHERE regexp_matches(content, '{_q(_ROLE)}')""")
def role_markers(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("record_id", F.regexp_count("content", F.lit(_ROLE)).alias("n")).where("n > 0").distinct()


_INJECTED = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(len(regexp_extract_all(content, '{_q(p)}')) AS BIGINT) AS n FROM {RECORDS} r" for k, p, _ in injection.KINDS)


@query(f"SELECT kind, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_records FROM ({_INJECTED}) u WHERE n > 0 GROUP BY kind")
def injection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of all instruction-shaped kinds."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("n")) for k, c in injection.injection_counts(F.col("content")).items()])
    df = records(spark, sf).select("record_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("record_id", "x.*").distinct()
    return df.groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_records"))


def _replaced_sql(text: str, rules) -> str:
    for pattern, by in rules:
        text = f"regexp_replace({text}, '{_q(pattern)}', '{_q(by).replace('$1', chr(92) + '1')}', 'g')"
    return text


_LIMIT = lx.MAX_PROMPT_CHARS
_CUT = f"CASE WHEN length(content) > {_LIMIT} THEN left(content, {_LIMIT}) || chr(10) || '[... ' || format('{{:,}}', length(content) - {_LIMIT}) || ' more characters omitted]' ELSE content END"


@query(f"""
SELECT record_id, md5('<untrusted_data id="fixed" label="excerpt">' || chr(10) || {_replaced_sql(_CUT, injection.NEUTRALISED)} || chr(10) || '</untrusted_data id="fixed">') AS excerpt FROM {RECORDS} r""")
def prompt_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of every record as an excerpt that a prompt may hold."""
    return records(spark, sf).select("record_id", F.md5(injection.enveloped(F.col("content"), "fixed")).alias("excerpt")).distinct()


def transcript_sql(text: str) -> str:
    return _replaced_sql(f"translate({text}, '{''.join(nz.FOLDS)}{lx.INVISIBLE}', '{''.join(nz.FOLDS.values())}')", injection.TRANSCRIPT)


@query(f"SELECT record_id, md5({transcript_sql('content')}) AS stored FROM {RECORDS} r")
def transcript_redact(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of every record as a transcript may keep it."""
    return records(spark, sf).select("record_id", F.md5(injection.transcript(F.col("content"))).alias("stored")).distinct()


@query(f"SELECT record_id, CAST(greatest(1, floor(length(content) / 4)) AS BIGINT) AS tokens, CAST(strlen(content) AS BIGINT) AS n_bytes FROM {RECORDS} r")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("record_id", fx.token_estimate(F.col("content")).alias("tokens"), F.octet_length("content").cast("bigint").alias("n_bytes")).distinct()


@query("""
SELECT record_id, is_clean, CAST(CASE WHEN n > 0 THEN round(least(1.0, bytes_total / CAST(n AS DOUBLE)) * 100, 1) ELSE 0.0 END AS DOUBLE) AS coverage_percent FROM (
  SELECT record_id, any_value(bytes_total) AS bytes_total, any_value(coalesce(verified_clean, false)) AS is_clean, any_value(CASE WHEN strlen(content) > 0 THEN strlen(content) END) AS n FROM content_record GROUP BY record_id) c""")
def coverage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "content_record").select("record_id", F.coalesce("verified_clean", F.lit(False)).alias("is_clean"), "bytes_total", F.octet_length("content").alias("n")).distinct()
    share = F.when(F.col("n") > 0, F.round(F.least(F.lit(1.0), F.col("bytes_total") / F.col("n").cast("double")) * 100, 1))
    return df.select("record_id", "is_clean", F.coalesce(share, F.lit(0.0)).alias("coverage_percent"))


@query(f"""
SELECT record_id, CAST(length(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')) >= 3 AND length(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) / CAST(length(content) AS DOUBLE) >= 0.5 AS BOOLEAN) AS substance FROM {RECORDS} r WHERE length(content) > 0""")
def substance(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where(F.length("content") > 0).select("record_id", fx.has_substance(F.col("content")).alias("substance")).distinct()


@query("""
SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""")
def dedupe_sha256(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
