"""What the two vector searches share: usable vectors, shards of the table, blocks of questions.

A cell of the grid holds one shard and one block. No pair of rows is ever written out: a task hands on
k rows per question and shard, and a window keeps the best k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.operators.scaling import top_per_group

SHARD_ROWS = 8192
BLOCK_ROWS = 4096


def finite(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def part(ids: str, n: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")


def cells(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def every_cell(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def matrix(column: pa.ChunkedArray, dim: int, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), dim)


def distinct_ids(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id, in id order; of different vectors under one id the smallest stays."""
    order = np.lexsort([*vectors.T[::-1], ids])
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest k of each row, ties to the smaller id. ids: one row for all, or one per row."""
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def ranked(local: DataFrame, k: int, score: str = "score") -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all shards."""
    best = top_per_group(local, ["query_id"], [F.col(score).desc(), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)
