"""Vector relation: embedding hook, unit vectors, exact top-k and top-k over pivot lists."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescout.functions.hashing import hash_rank
from tablescout.operators.topk import Best, answer_schema, as_ids, merged, millionths, question_blocks
from tablescout.session import text_batches

QUERY_BLOCK = 1_024
VECTOR_ROWS = 4_096
PRODUCTS = 1 << 20  # inner products that are held at once
PIVOT_FACTOR, MAX_PIVOTS = 6, 32_768
ASKED_SHARE = 0.27
LISTED = 1_000


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Offline default model: counts of words hashed to `dim` buckets, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import re

        slot: dict[str, int] = {}
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for w in re.split(r"[^\w]+", text.lower()):
                if len(w) < 2:
                    continue
                if w not in slot:
                    slot[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
                out[i, slot[w]] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)

    return embed


def embed_column(df: DataFrame, text: str = "text", embed=None, dim: int = 64, chunk: int = 30_000) -> DataFrame:
    """Adds `vector` through a batch hook embed(list[str]) -> matrix; at most `chunk` texts per call."""
    text_batches(df.sparkSession)
    embed = embed or hashed_embedder(dim)
    schema = T.StructType(df.schema.fields + [T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk].copy()
                part["vector"] = list(np.asarray(embed(part[text].fillna("").tolist()), dtype=float))
                yield part

    return df.mapInPandas(run, schema)


def unit(v) -> Column:
    """L2-normalised copy of a vector column, in double precision; a zero vector stays zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def cosine(a, b) -> Column:
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z
        )

    a, b = F.col(a), F.col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


@dataclass
class _Asked:
    """A block of questions as every task gets it; `lists[question, list]` where only some lists are asked."""

    ids: list
    matrix: np.ndarray
    lists: np.ndarray | None = None


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    vectors = batch.column("vector")
    return as_ids(batch.column("doc_id")), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _topk_map(shared, k: int, query_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        best = Best(len(asked.ids), k)
        every = np.arange(len(asked.ids))
        step = _rows_at_once(len(asked.ids))
        for batch in batches:
            ids, vectors = _rows_of(batch)
            if asked.lists is None:
                spans = [(a, min(a + step, len(ids)), every) for a in range(0, len(ids), step)]
            else:
                lists = batch.column("list").to_numpy(zero_copy_only=False)
                order = np.argsort(lists, kind="stable")
                ids, vectors, lists = ids[order], vectors[order], lists[order]
                edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
                spans = [(a, min(a + step, z), np.flatnonzero(asked.lists[:, lists[s]])) for s, z in zip(edges, edges[1:]) for a in range(s, z, step)]
            for a, b, rows in spans:
                if len(rows):
                    best.add(rows, millionths(asked.matrix[rows] @ vectors[a:b].T), ids[a:b])
        yield from best.batch(asked.ids, query_type, id_type)

    return run


def _rows_at_once(others: int) -> int:
    """Rows whose inner products with `others` vectors are held at once."""
    return max(1, min(VECTOR_ROWS, PRODUCTS // max(1, others)))


def _matrix(rows: list) -> np.ndarray:
    return np.array([r["vector"] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _search(queries: DataFrame, vectors: DataFrame, k: int, lists_of: Callable | None = None) -> DataFrame:
    spark = vectors.sparkSession
    text_batches(spark)
    types = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    schema, parts = answer_schema(*types), []
    vectors = vectors.where(F.size("vector") > 0)
    for block in question_blocks(queries.select("query_id", "vector").where(F.size("vector") > 0), QUERY_BLOCK):
        asked = _Asked([r["query_id"] for r in block], _matrix(block))
        corpus = vectors.select("doc_id", "vector")
        if lists_of is not None:
            asked.lists = lists_of(asked.matrix)
            any_ = np.flatnonzero(asked.lists.any(axis=0)).tolist()
            corpus = vectors.select("doc_id", "vector", "list")
            if len(any_) <= LISTED:  # few lists: others are not even read
                corpus = corpus.where(F.col("list").isin(any_))
        kernel = _topk_map(spark.sparkContext.broadcast(asked), k, to_arrow_type(types[0]), to_arrow_type(types[1]))
        parts.append(corpus.mapInArrow(kernel, schema))
    return merged(parts, schema, spark, k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of every question: query_id, doc_id, score (six digits), rank.

    queries(query_id, vector) and vectors(doc_id, vector) hold unit vectors. Questions go to all tasks in blocks of
    QUERY_BLOCK; the corpus is mapped once a block and never moves, and a task hands on k rows per question."""
    return _search(queries, vectors, k)


def pivot_count(n: int) -> int:
    return max(1, min(MAX_PIVOTS, math.ceil(PIVOT_FACTOR * math.sqrt(n))))


def pivot_lists(vectors: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pivots, filed): about 6 * sqrt(n) vectors drawn by hash rank, at most MAX_PIVOTS, as pivots(list, vector), and all
    rows with `list`, the number of their nearest pivot (ties to the lower number)."""
    spark = vectors.sparkSession
    text_batches(spark)
    drawn = vectors.where(F.size("vector") > 0).orderBy(hash_rank(seed, F.col("doc_id")), "doc_id").limit(pivot_count(vectors.count()))
    rows = drawn.select("vector").collect()
    shared = spark.sparkContext.broadcast(_matrix(rows))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, vectors = _rows_of(batch)
            step = _rows_at_once(len(shared.value))
            near = [millionths(vectors[a : a + step] @ shared.value.T).argmax(axis=1) for a in range(0, len(vectors), step)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*near, np.zeros(0, int)]).astype(np.int32))], [*batch.schema.names, "list"])

    pivots = spark.createDataFrame([(i, r["vector"]) for i, r in enumerate(rows)], "list int, vector array<double>")
    kept = vectors.select("doc_id", "vector").where(F.size("vector") > 0)
    return pivots, kept.mapInArrow(file, T.StructType([*kept.schema.fields, T.StructField("list", T.IntegerType())]))


def lists_topk(queries: DataFrame, filed: DataFrame, pivots: DataFrame, k: int, share: float = ASKED_SHARE) -> DataFrame:
    """Approximate cosine top-k: a question asks the lists of its nearest pivots, nearest first, until they hold `share`
    of all vectors; rows of other lists are not compared. share = 1 is exact.

    pivots(list, vector, size): sizes may come with the pivots (a stored index) or are counted here."""
    sized = pivots if "size" in pivots.columns else pivots.join(filed.groupBy("list").agg(F.count(F.lit(1)).alias("size")), "list", "left")
    rows = sorted(sized.collect(), key=lambda r: r["list"])
    if not rows:
        types = queries.schema["query_id"].dataType, filed.schema["doc_id"].dataType
        return merged([], answer_schema(*types), filed.sparkSession, k)
    matrix, sizes = _matrix(rows), np.array([r["size"] or 0 for r in rows], float)

    def lists_of(questions: np.ndarray) -> np.ndarray:
        order = np.argsort(-millionths(questions @ matrix.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        asked = np.zeros(order.shape, bool)
        np.put_along_axis(asked, order, before < share * sizes.sum(), 1)
        return asked

    def asked_lists(questions: np.ndarray) -> np.ndarray:
        step = _rows_at_once(len(matrix))
        return np.concatenate([lists_of(questions[a : a + step]) for a in range(0, len(questions), step)])

    return _search(queries, filed, k, asked_lists)
