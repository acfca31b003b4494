from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark import api
from veilspark.functions import text as fx
from veilspark.operators import asof, audit, intervals, similarity, vault
from veilspark.sources import files
from veilspark.streaming import scrub as stream


def test_spans(spark):
    df = spark.createDataFrame([(1, "x é a1 b22 🙂c3"), (2, "none"), (3, None), (4, "a1")], "id bigint, t string")
    got = sorted(tuple(r) for r in fx.spans(df, "t", "[a-z][0-9]+", "id").collect())
    assert got == [(1, 4, 6, "a1"), (1, 7, 10, "b22"), (1, 12, 14, "c3"), (4, 0, 2, "a1")]


def test_checksums_agree_with_python(spark):
    from veilspark.operators import detect

    rng = random.Random(2)
    cards = ["".join(rng.choice("0123456789") for _ in range(rng.choice((12, 13, 16, 19, 20)))) for _ in range(60)] + ["4111111111111111"]
    ibans = ["GB82WEST12345698765432", "GB82WEST12345698765433", "DE89 3704 0044 0532 0130 00", "x"]
    cards += ["0" * 16, "1" * 13]
    df = spark.createDataFrame([(c,) for c in cards], "c string").select("c", fx.luhn_ok(F.col("c")).alias("ok"))
    assert all(r.ok == detect.luhn_ok(r.c) for r in df.collect())
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ibans], "i string").select(fx.iban_ok(F.col("i"))).collect()] == [detect.iban_ok(i) for i in ibans]
    api.register_functions(spark)
    assert spark.sql("SELECT luhn_ok('4111111111111111') AND NOT aba_ok('1')").first()[0]


def test_asof(spark):
    t0 = datetime(2025, 1, 1)
    rng = random.Random(3)
    asks = [(i, rng.choice("ab"), t0 + timedelta(hours=rng.randrange(20))) for i in range(40)] + [(99, "z", t0), (98, None, t0)]
    rows = [(k, t0 + timedelta(hours=h), h) for k in "ab" for h in (2, 5, 5, 11)]
    got = {r.id: r.v for r in asof.latest_before(spark.createDataFrame(asks, "id int, k string, at timestamp"), spark.createDataFrame(rows, "k string, since timestamp, v int"), ["k"], "at", "since", ["v"]).collect()}
    assert got == {i: max([v for k2, s, v in rows if k2 == k and s <= at], default=None) for i, k, at in asks}


def test_intervals(spark):
    rng = random.Random(4)
    rows = [(g, a, a + rng.randrange(1, 30)) for g in (1, 2) for a in (rng.randrange(200) for _ in range(40))]
    df = spark.createDataFrame(rows, "g int, s int, e int")
    got = {(r.g, r.s, r.e) for r in intervals.merged(df, ["g"], "s", "e").collect()}
    for g in (1, 2):
        covered = {x for k, a, b in rows if k == g for x in range(a, b)}
        assert {x for k, a, b in got if k == g for x in range(a, b)} == covered
    ids = [(n, *r) for n, r in enumerate(rows)]
    a = spark.createDataFrame(ids, "ia int, g int, start_a int, end_a int")
    b = a.toDF("ib", "g", "start_b", "end_b")
    pairs = [(r.ia, r.ib) for r in intervals.overlapping(a, b, ["g"], 7).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x[0], y[0]) for x, y in itertools.product(ids, ids) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}


@pytest.mark.parametrize("block", [2, 20_000])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(100, None), (101, [1.0]), (102, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in similarity.nearest(df, df.where("vec_id in (0, 7, 9)"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    vectors = {i: v for i, v in rows if v and len(v) == 6}
    for q in (0, 7, 9):
        want = sorted((i for i in vectors if i != q), key=lambda i: (-cos(vectors[q], vectors[i]), i))[:5]
        assert [got[q][k] for k in range(1, 6)] == want
    assert similarity.nearest(df, df.where("false")).count() == 0


def test_vault_tables(spark):
    values = spark.createDataFrame([("a", "IBAN_CODE"), ("a", "US_BANK_NUMBER"), ("b", "IBAN_CODE"), ("1", "CVV"), (None, "IBAN_CODE")], "value string, type string")
    first = {r.digest: r.surrogate for r in vault.surrogates(values, b"s" * 16).collect()}
    assert len(first) == 2 and {r.digest: r.surrogate for r in vault.surrogates(values.repartition(3), b"s" * 16).collect()} == first
    assert not set(first.values()) & {r.surrogate for r in vault.surrogates(values, b"t" * 16).collect()}
    assert vault.digests(values, b"s" * 16, rounds=2).count() == 2
    allowed = spark.createDataFrame([("P", __import__("hashlib").sha256(b"sa").hexdigest())], "profile string, digest string")
    assert [r.value for r in vault.suppress_allowed(values.where("value is not null").select("value").distinct().withColumn("profile", F.lit("P")), allowed, "s").orderBy("value").collect()] == ["1", "b"]


def test_native_normalisation_agrees_with_python(spark):
    from veilspark.operators import normalize as nz

    texts = ["a b c", "id 1 2 3 4 end", "4 1 7 - 8 2 - 6 3 9 0", "x 1 2 3 y", "a\tb c d", "1 2 3 4\n5 6 7 8", "", "plain", "é 1 2 3 4 é", " 1 2 3 4 5 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nz.collapsed_column(F.col("t")).alias("c"), nz.without_whitespace_column(F.col("t")).alias("w"))
    assert all(r.c == nz.collapse_spaced(r.t)[0] and r.w == nz.without_whitespace(r.t)[0] for r in df.collect())
    assert nz.without_whitespace("a b")[1] == [0, 2]


def test_stored_chains(spark):
    import hashlib

    rows, last = [], audit.GENESIS
    for n in range(4):
        h = hashlib.sha256(f"p{n}|{last}".encode()).hexdigest()
        rows.append(("c", n, f"p{n}", last, h))
        last = h
    df = spark.createDataFrame(rows, "chain string, seq int, payload string, prev_hash string, record_hash string")
    assert audit.broken_links(df, "chain", "seq").count() == 0
    assert audit.broken_links(df.where("seq <> 1"), "chain", "seq").count() == 1
    assert audit.broken_links(df.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload"))), "chain", "seq").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".ssh").mkdir()
    for name, data in {"a.txt": b"hello", "sub/b.LOG": b"x", "sub/c.log": b"\xffbad", "d.exe": b"no", ".ssh/e.txt": b"no", "id_rsa.txt": b"yes"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad.json").write_bytes(b'{"a": ')
    (tmp_path / "good.json").write_bytes(b'{"a": {"b": 1}}')
    (tmp_path / "credentials.json").write_bytes(b"{}")
    got = {r.path: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {p: (r.content, r.replaced) for p, r in got.items() if r.refusal is None} == {"id_rsa.txt": ("yes", 0), "a.txt": ("hello", 0), "sub/c.log": ("�bad", 1), "bad.json": ('{"a": ', 0), "good.json": ("a: a\na.b: b\na.b: 1", 0)}
    assert got["credentials.json"].refusal == "sensitive name"
    assert got["credentials.json"].content is None and ".ssh/e.txt" not in got and got["bad.json"].warning and got["good.json"].warning is None
    assert [r.path for r in files.list_sources(spark, str(tmp_path)).collect()] == ["a.txt", "bad.json", "good.json", "id_rsa.txt", "sub/c.log"]
    long = spark.createDataFrame([("x" * 100_001,), ("ok",), (None,)], "content string")
    assert [(r.content, r.refusal) for r in files.pasted(long).collect()] == [(None, "longer than 100000 characters"), ("ok", None), (None, "no text")]
    inside = spark.createDataFrame([("/data/x.txt",), ("/data-old/x.txt",), ("file:///data/a/b.txt",), ("/data/../etc/x.txt",)], "p string").select(files.contained(F.col("p"), ["/data"]).alias("ok"))
    assert [r.ok for r in inside.collect()] == [True, False, True, False]
    paths = spark.createDataFrame([("../x.txt",), ("/x.txt",), ("a/.aws/x.txt",), ("a/x.pem",), ("a/x.bin",), ("a/x.csv",)], "p string")
    assert [r[0] for r in paths.select(files.path_problem(F.col("p"))).collect()] == ["traversal", "absolute", "sensitive folder", "sensitive name", "extension", None]
    assert files.object_path("/r", "w", "kind", "id") == "/r/w/kind/id"
    with pytest.raises(ValueError):
        files.object_path("/r", "..", "x")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "password=hunter2secret", datetime(2025, 1, 1)), ("b", "ok", datetime(2025, 1, 1))], "k string, t string, at timestamp").write.parquet(source)
    schema = "k string, t string, at timestamp"
    contents = spark.readStream.schema(schema).parquet(source)
    from veilspark.operators.scrub import Options

    q = stream.scrub_stream(contents, "k", "t", str(tmp_path / "out"), str(tmp_path / "cp"), Options(profiles=("BASE_SECURITY",)))
    assert q.awaitTermination(120)
    assert {r.key: r.artifact for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "[REDACTED:PASSWORD]", "b": "ok"}
    counted = stream.windowed_findings(spark.read.schema(schema).parquet(source), "at", "t", {"KV": "password="})
    assert [(r.type, r.n) for r in counted.collect()] == [("KV", 1)]


def test_explain():
    assert api.explain_profile("DEFAULT_PII")["max_pattern_span"] == 8192


def test_objects(spark, tmp_path):
    store = files.Objects(spark, str(tmp_path / "objects"))
    row = lambda w, k, i, p: (w, k, i, bytearray(p))
    frame = lambda *rows: spark.createDataFrame(list(rows), files.Objects.SCHEMA)
    assert store.read("w").count() == 0
    store.put(frame(row("w", "original", "1", b"a"), row("w", "original", "2", b"b"), row("w", "sanitized", "1", b"c"), row("v", "original", "1", b"d")))
    store.put(frame(row("w", "original", "1", b"A")))
    assert {(r.kind, r.id, bytes(r.payload)) for r in store.read("w").collect()} == {("original", "1", b"A"), ("original", "2", b"b"), ("sanitized", "1", b"c")}
    assert store.delete("w", "original", ["1", "9"]) == 1 and store.delete("w", "original", ["1"]) == 0
    assert store.delete("w", "original", ["2"]) == 1 and store.read("w", "original").count() == 0
    assert store.delete_prefix("w") and store.read("w").count() == 0 and store.read("v").count() == 1
    with pytest.raises(ValueError):
        store.put(frame(row("w", "other", "1", b"a")))
    assert files.object_key("w", "chunk", "7") == "w/chunk/7"


def test_audit_sink(spark, tmp_path):
    rows = spark.createDataFrame([("s", n, datetime(2025, 1, 1 + n), "scan") for n in range(4)], "chain string, seq int, at timestamp, event string")
    files.append_audit(rows, str(tmp_path / "audit"), "at", "chain", ["seq"])
    back = files.read_audit(spark, str(tmp_path / "audit"), "chain", ["seq"])
    assert back.count() == 4 and audit.broken_links(back, "chain", "seq").count() == 0
    assert audit.broken_links(back.withColumn("payload", F.when(F.col("seq") == 1, "x").otherwise(F.col("payload"))), "chain", "seq").count() == 1
    with pytest.raises(ValueError, match="b.value"):
        files.append_audit(rows.withColumn("b", F.array(F.struct(F.lit(1).alias("value")))), str(tmp_path / "no"), "at", "chain", ["seq"])


def test_public_surface(spark, tmp_path):
    df = spark.createDataFrame([("1", "password=hunter2secret"), ("2", None)], "k string, t string")
    assert [(r.key, r.type, r.preview) for r in api.detect(df, "k", "t").collect()] == [("1", "PASSWORD", "[PASSWORD]")]
    p = api.Preferences()
    p.set("profiles", "BASE_SECURITY, AI_SAAS")
    p.set("dry_run", "yes")
    p.set("threshold", "0.5")
    assert p.options(threshold=0.7, destination="S3") == api.Options(profiles=("BASE_SECURITY", "AI_SAAS"), dry_run=True, threshold=0.7, destination="S3")
    for name, value in (("nope", 1), ("profiles", "NOPE"), ("destination", "MOON"), ("threshold", 2)):
        with pytest.raises(ValueError):
            p.set(name, value)
    parts = api.health(spark, roots=[str(tmp_path)])
    assert api.overall(parts) == "unavailable" and api.blockers(parts) == ["named entities", "audit"]
    assert api.overall(api.health(spark, ner=lambda t: [], roots=[str(tmp_path)], audit=str(tmp_path))) == "ok"
    kinds = api.catalog()
    assert kinds[0]["severity"] == "HIGH" and kinds[-1]["severity"] == "LOW" and {"type": "JWT", "severity": "HIGH", "detector": "custom_security", "profiles": ["BASE_SECURITY"]} in kinds
    assert "PERSON" in api.refusal_text("NEEDS_DESTINATION", ["PERSON"]) and api.refusal_text(None) == ""
