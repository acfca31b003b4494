"""Queries of the core, by name; ``ORACLE`` has the same result in plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.operators.logparse import parse_logs
from veilspark.session import spread, tuned

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose texts are worked on."""
    return spread(table(tuned(spark), sf, name))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_logs(texts(spark, sf, "content_record"), message=False)


@query()
def p1_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The same with each entry's message: all its text after the header."""
    return parse_logs(texts(spark, sf, "content_record"))
