"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python. Texts run to hundreds of kilobytes, so batches stay short.
ARROW_ROWS = 512


def tuned(spark: SparkSession) -> SparkSession:
    """Set the few session options that the Python stages rely on; all are safe to set again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Where neither that setting nor the context's own folder is set, a temporary folder is made on a local
    master (tests); on a cluster a folder of one machine would be lost with it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilspark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a compressed table in the shared folder, for as long as it is read more than once; removed after."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A table of more bytes is never moved to spread it: the scan's own splits are enough then.
SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table of few files over all cores, for work that costs far more than moving a row.

    Few means fewer files than cores, small at most :data:`SPREAD_BYTES` on disk, so what is moved has a
    fixed bound on any cluster. Column pruning and filters still reach the scan.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df
