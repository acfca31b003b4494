"""Surrogates and digests that are stable over a whole table."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import lexicon as lx
from veilspark.operators.rewrite import surrogate_of

#: Entries of an allowlist that tasks take with them; a longer one is a table for :func:`suppress_allowed`.
MAX_ALLOWED = 200_000


@dataclass(frozen=True)
class Allowlist:
    """Values that users confirmed to be no findings: salted digests by profile, and masked labels to show.

    The values themselves are not kept.
    """

    salt: str = ""
    entries: frozenset[tuple[str, str]] = frozenset()
    labels: tuple[tuple[str, str], ...] = ()

    def digest(self, value: str) -> str:
        return hashlib.sha256(f"{self.salt}{value}".encode()).hexdigest()

    def add(self, profile: str, value: str) -> Allowlist:
        if len(self.entries) >= MAX_ALLOWED:
            raise ValueError(f"more than {MAX_ALLOWED} entries: join them with suppress_allowed")
        label = "*" * len(value) if len(value) <= 4 else f"{value[:2]}{'*' * (len(value) - 4)}{value[-2:]}"
        return Allowlist(self.salt, self.entries | {(profile, self.digest(value))}, (*self.labels, (profile, label)))

    def holds(self, profile: str, value: str) -> bool:
        return bool(self.entries) and (profile, self.digest(value)) in self.entries

    def entries_for(self, profile: str) -> list[str]:
        return [label for p, label in self.labels if p == profile]


NOTHING = Allowlist()


def surrogates(values: DataFrame, salt: bytes) -> DataFrame:
    """``digest, surrogate, type`` of every distinct value of (value, type): which surrogate stands for which digest.

    The surrogates are those that TOKENIZE writes under the same salt. Types never tokenised give none.
    The type is the least by name. Values are digested in the JVM before anything is shuffled.
    """

    @F.pandas_udf("string")
    def keyed(digest: pd.Series) -> pd.Series:
        return digest.map(lambda d: surrogate_of(d, salt))

    distinct = values.where(F.col("value").isNotNull() & ~F.col("type").isin(*lx.NEVER_TOKENIZED)).groupBy(F.sha2("value", 256).alias("digest")).agg(F.min("type").alias("type"))
    return distinct.select("digest", keyed("digest").alias("surrogate"), "type")


def resolved(markers: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Rows of ``markers`` whose surrogate stands in ``column``, with the ``digest`` behind it (for operators who may ask)."""
    inner = F.regexp_extract(column, "^<[A-Z][A-Z0-9_]*:([0-9a-f]{32})>$", 1)
    return markers.withColumn("_s", inner).join(table.select(F.col("surrogate").alias("_s"), "digest"), "_s").drop("_s")


def owns(markers: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Rows whose surrogate is one of this vault."""
    inner = F.regexp_extract(column, "^<[A-Z][A-Z0-9_]*:([0-9a-f]{32})>$", 1)
    return markers.withColumn("_s", inner).join(table.select(F.col("surrogate").alias("_s")), "_s", "left_semi").drop("_s")


def summary(table: DataFrame) -> DataFrame:
    """Surrogates by type."""
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def digests(values: DataFrame, salt: bytes, rounds: int = lx.PBKDF2_ROUNDS) -> DataFrame:
    """``value, digest`` (PBKDF2, 16 hex digits) of every distinct value of (value, type); low-entropy types give none."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda s: hashlib.pbkdf2_hmac("sha256", s.encode(), salt, rounds).hex()[:16])

    distinct = values.where(F.col("value").isNotNull() & ~F.col("type").isin(*lx.LOW_ENTROPY)).select("value").distinct()
    return distinct.withColumn("digest", run("value"))


def suppress_allowed(found: DataFrame, allowlist: DataFrame, salt: str) -> DataFrame:
    """Findings (value, profile) that are not on the allowlist of salted digests."""
    key = F.sha2(F.concat(F.lit(salt), "value"), 256)
    return found.withColumn("_digest", key).join(allowlist.select(F.col("profile"), F.col("digest").alias("_digest")).distinct(), ["profile", "_digest"], "left_anti").drop("_digest")
