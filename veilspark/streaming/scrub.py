"""The scrub on a stream, and windows over its findings.

Work on a row needs no state, so the batch operators run as they are in every micro-batch; the sink is
made idempotent by writing each batch to a folder of its own number, so a batch that is run again after
a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import scrub as sc


def scrub_stream(contents: DataFrame, key: str, text: str, path: str, checkpoint: str, options: sc.Options | None = None) -> StreamingQuery:
    """Scrub a stream of contents into parquet files at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        sc.scrub(batch, key, text, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return contents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_findings(contents: DataFrame, at: str, text: str, patterns: dict[str, str], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Occurrences by type in windows of event time; rows later than the watermark are left out."""
    counts = F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_count(text, F.lit(p)).cast("bigint").alias("c")) for k, p in patterns.items()])
    marked = contents.withWatermark(at, late).select(F.col(at), F.explode(F.filter(counts, lambda x: x["c"] > 0)).alias("x"))
    return marked.groupBy(F.window(at, window), F.col("x.type").alias("type")).agg(F.sum("x.c").alias("n"))
