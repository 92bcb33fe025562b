"""Best answers per question, kept by every task while it reads its part of a corpus once.

Questions are few at a time and go to all tasks as arrays; the corpus stays where it is. A task holds k answers per
question, and only those leave it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.operators.scaling import top_per_group

LOW = -(1 << 40)


def question_blocks(questions: DataFrame, rows: int) -> Iterator[list]:
    """The rows of a question relation in lists of about `rows`, all rows of a question in one list; a batch that fits is
    read by one job."""
    first = questions.limit(rows + 1).collect()
    if len(first) <= rows:
        if first:
            yield first
        return
    blocks = -(-questions.count() // rows)
    for b in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if part:
            yield part


def as_ids(column) -> np.ndarray:
    """Ids of an Arrow column as an array that sorts like the column does."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.str_)
    return column.to_numpy(zero_copy_only=False)


def millionths(scores: np.ndarray) -> np.ndarray:
    """Scores rounded to six digits, as whole numbers, so that equal ones are equal."""
    return np.rint(scores * 1e6).astype(np.int64)


class Best:
    """The k best (score, id) of each question; scores are whole millionths, ties go to the smaller id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.score = np.full((questions, k), LOW, np.int64)
        self.id: np.ndarray | None = None

    @property
    def least(self) -> np.ndarray:
        """What an answer must at least reach to get in."""
        return self.score[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[row, id]; entries of LOW are no answers."""
        useful = scores.max(axis=1, initial=LOW) >= np.maximum(self.least[rows], LOW + 1)
        if not useful.any():
            return
        rows, scores = rows[useful], scores[useful]
        order = np.argsort(ids, kind="stable")
        ids, scores, n = ids[order], scores[:, order], len(ids)
        if n > self.k:
            place = scores * n + np.arange(n - 1, -1, -1)
            pick = np.argpartition(-place, self.k - 1, axis=1)[:, : self.k]
            scores, found = np.take_along_axis(scores, pick, 1), ids[pick]
        else:
            found = np.broadcast_to(ids, scores.shape)
        if self.id is None:
            self.id = np.zeros(self.score.shape, ids.dtype)
        elif ids.dtype.itemsize > self.id.dtype.itemsize:
            self.id = self.id.astype(ids.dtype)
        all_scores = np.concatenate([self.score[rows], scores], axis=1)
        all_ids = np.concatenate([self.id[rows], found], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(all_scores, order, 1)
        self.id[rows] = np.take_along_axis(all_ids, order, 1)

    def batch(self, query_ids: list, query_type: pa.DataType, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.id is None:
            return
        row, place = np.nonzero(self.score > LOW)
        ids = self.id[row, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array([query_ids[i] for i in row], query_type), pa.array(ids.tolist(), id_type), pa.array(self.score[row, place] / 1e6)],
            ["query_id", "doc_id", "score"],
        )


def answer_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])


def merged(parts: list[DataFrame], schema: T.StructType, spark: SparkSession, k: int) -> DataFrame:
    """The k best over all tasks and parts, with their rank; at most tasks * k rows per question move."""
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return top_per_group(every, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
