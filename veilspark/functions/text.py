"""Native column expressions: spans with offsets, checksums, previews, estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import lexicon as lx


def spans(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """Every match of a pattern with its offsets (``start_pos``, ``end_pos``, ``value``), in the JVM.

    Java's expressions tell no offsets, but the pieces between matches do: a match starts where the
    pieces and matches before it end. Matches must not be empty.
    """
    whole = F.col(text)
    found = df.where(whole.rlike(pattern)).withColumn("_m", F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).withColumn("_p", F.split(whole, pattern, -1))
    # a piece and the match after it, with the length of all before
    steps = F.aggregate(
        F.arrays_zip(F.transform("_m", lambda m: m).alias("m"), F.slice("_p", F.lit(1), F.size("_m")).alias("p")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_pos:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["p"])).alias("start_pos"), x["m"].alias("value"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return found.select(*keep, F.explode(steps).alias("s")).select(*keep, F.col("s.start_pos").alias("start_pos"), (F.col("s.start_pos") + F.length("s.value")).alias("end_pos"), F.col("s.value").alias("value"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(text: Column) -> Column:
    """The card checksum over the digits of a text of 13 to 19 digits, not all the same."""
    d = digits(text)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when((F.length(d) - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise((F.substring(d, i, F.lit(1)).cast("int") * 2) - F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    varied = F.replace(d, F.left(d, F.lit(1)), F.lit("")) != ""
    return F.when(F.length(d).between(13, 19) & varied, total % 10 == 0).otherwise(F.lit(False))


def aba_ok(text: Column) -> Column:
    """The 3-7-1 checksum over nine digits that are not all zero."""
    d = digits(text)
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return F.when((F.length(d) == 9) & (d != "000000000"), total % 10 == 0).otherwise(F.lit(False))


def iban_ok(text: Column) -> Column:
    """The mod-97 checksum, digit by digit so that no number grows too large."""
    s = F.upper(F.regexp_replace(text, "[ -]", ""))
    moved = F.concat(F.substring(s, 5, 64), F.left(s, F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def preview(value: Column, kind: Column, severity: Column) -> Column:
    """A preview that a log may show."""
    n = F.length(value)
    masked = F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))
    return F.when(severity == "HIGH", F.concat(F.lit("["), kind, F.lit("]"))).otherwise(masked)


def severity_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in lx.SEVERITY.items() for x in kv])
    return F.coalesce(table[F.upper(kind)], F.lit("MEDIUM"))


def action_rank(action: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in lx.ACTIONS.items() for x in kv])[action]


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def has_substance(text: Column) -> Column:
    """Three letters or digits at least, and no more blanks than characters (F4), for ASCII texts."""
    return (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) >= 3) & (F.length(F.regexp_replace(text, r"\s", "")) / F.length(text) >= 0.5)


def register(spark) -> None:
    """The checksums and the normalisation as SQL functions, in whole batches."""
    from veilspark.operators import detect, normalize

    def vectorised(f, kind: str):
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else f(v) for v in values], dtype=object)

        return run

    for name, f in (("luhn_ok", detect.luhn_ok), ("iban_ok", detect.iban_ok), ("aba_ok", detect.aba_ok)):
        spark.udf.register(name, vectorised(f, "boolean"))
    spark.udf.register("normalize_text", vectorised(lambda s: normalize.normalize(s)[0], "string"))
