"""The latest row of one table at or before the time of another (Q-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, take: list[str]) -> DataFrame:
    """``left`` with ``take`` of the row of ``right`` with the greatest ``since`` <= ``at``; NULLs if there is none.

    Both sides go through one window per key in time order, the right side first at equal times, and the
    last right row seen is carried on: no range join, however many rows a key has.
    """
    carried = F.struct(F.col(since).alias("_since"), *[F.col(c) for c in take])
    points = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_o"), carried.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    asks = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(points.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = points.unionByName(asks).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_o = 1")
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in take])
