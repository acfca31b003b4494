"""Intervals: overlaps within a group, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """The union of a group's intervals: touching and overlapping ones become one."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*group, start, end).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlapping(a: DataFrame, b: DataFrame, group: list[str], width: int) -> DataFrame:
    """Pairs of intervals (start_a, end_a) and (start_b, end_b) of a group that overlap, half open.

    Each interval is placed in every bin of ``width`` it touches, and a pair is reported only in the
    first bin it shares: an equi-join on group and bin, with no pairs of far-apart intervals.
    """

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    left, right = binned(a, "start_a", "end_a"), binned(b, "start_b", "end_b")
    both = left.join(right, [*group, "_bin"]).where((F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a")))
    return both.where(F.col("_bin") == F.floor(F.greatest("start_a", "start_b") / width)).drop("_bin")
