"""Exact nearest vectors for a stated set of queries (Q-19)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to the tasks at once; more are taken block by block.
BLOCK = 20_000


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank`` of the k rows of greatest cosine for every query, itself apart.

    Every partition multiplies its rows with a block of queries and keeps k for each; only those are
    shuffled. Ties go to the smaller id. Vectors of another length than the query's are no match.
    """
    spark = vectors.sparkSession
    parts = None
    block: list[tuple[int, list]] = []

    def against(rows: list[tuple[int, list]]) -> DataFrame:
        table = spark.sparkContext.broadcast(rows)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width = len(table.value[0][1])
            ids = np.array([r[0] for r in table.value], dtype=np.int64)
            q = _unit([r[1] for r in table.value])
            best_s = np.full((len(ids), k), -np.inf)
            best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                got = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == width]
                if not got:
                    continue
                own = np.array([i for i, _ in got], dtype=np.int64)
                score = np.round(q @ _unit([v for _, v in got]).T, 9)
                score[ids[:, None] == own[None, :]] = -np.inf
                score[score < least] = -np.inf
                s = np.concatenate([best_s, score], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(own, score.shape)], axis=1)
                if s.shape[1] > 4 * k:
                    # only what reaches the k-th best score, ties included, is sorted
                    least_kept = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
                    width_kept = int((s >= least_kept).sum(axis=1).max())
                    part = np.argpartition(-s, min(width_kept, s.shape[1] - 1), axis=1)[:, :width_kept]
                    s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            ok = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[ok.ravel()]), pa.array(best_i[ok]), pa.array(best_s[ok])], names=["query_id", key, "score"])

        return vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"query_id bigint, {key} bigint, score double")

    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == BLOCK:
            parts = against(block) if parts is None else parts.unionByName(against(block))
            block = []
    if block:
        parts = against(block) if parts is None else parts.unionByName(against(block))
    if parts is None:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, model: str, version: str, workspace: str | None = None, k: int = 10, least: float = -1.0) -> DataFrame:
    """:func:`nearest` among the vectors of one model and version, of one workspace where given.

    Vectors of different models cannot be compared: a query of another model, or of another length than the
    model's vectors, is refused.
    """
    same = (F.col("embedding_model") == model) & (F.col("embedding_model_version") == version)
    if queries.where(~F.coalesce(same, F.lit(False))).limit(1).count():
        raise ValueError(f"a query is not of {model} {version}")
    own = vectors.where(same if workspace is None else same & (F.col("workspace_id") == workspace)).select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"))
    asked = queries.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"))
    lengths = own.unionByName(asked).where("embedding is not null").select(F.size("embedding").alias("n")).distinct().limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    return nearest(own, asked, k, least)
