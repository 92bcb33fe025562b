"""Exact top-k by vector-approximation files.

Every shard keeps, beside its exact vectors, a file of quantised cells: CELL_BITS bits a component over
the shard's own range. A question first scans the cells only and bounds every score from above and
below, then reads exact vectors in the order of their upper bounds until the k-th exact score beats
every bound that is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import written
from tablescout.llm.vector_grid import BLOCK_ROWS, SHARD_ROWS, cells, distinct_ids, every_cell, matrix, part, ranked

CELL_BITS = 4
STEP_QUERIES = 256
EXACT = 2**53
LONG = 2**63

_INDEX = "dim int, shard int, n int, ids binary, low binary, width binary, cells binary, exact binary"


def build_file(ids: np.ndarray, vectors: np.ndarray, bits: int = CELL_BITS) -> dict[str, bytes]:
    """Cells of width (range // 2^bits) + 1 per component, so a cell holds whole numbers only."""
    low = vectors.min(axis=0)
    span = vectors.max(axis=0).astype(object) - low.astype(object) if len(low) else np.zeros(0, object)
    width = np.array([int(s) // 2**bits + 1 for s in span], np.uint64)
    at = ((vectors.astype(np.uint64) - low.astype(np.uint64)) // width).astype(np.uint8)  # wraps to the true difference
    return {"ids": ids.astype(np.int64).tobytes(), "low": low.astype(np.int64).tobytes(), "width": width.tobytes(),
            "cells": at.tobytes(), "exact": vectors.astype(np.int64).tobytes()}


def _exact_scores(q: np.ndarray, v: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return (v.astype(np.float64) @ q.astype(np.float64))
    return np.array([max(-LONG, min(LONG - 1, sum(int(a) * int(b) for a, b in zip(q, row)))) for row in v], object)


def search_file(file: dict, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """Best k of the shard for every question: query ids, vector ids, scores. The question's own id is left out."""
    n, dim = file["n"], file["dim"]
    ids = np.frombuffer(file["ids"], np.int64)
    exact = np.frombuffer(file["exact"], np.int64).reshape(n, dim)
    at = np.frombuffer(file["cells"], np.uint8).reshape(n, dim)
    low = np.frombuffer(file["low"], np.int64)
    width = np.frombuffer(file["width"], np.uint64)
    # Twice the cell's middle and twice its half width: whole numbers, exact in doubles below 2^53.
    double_middle = at.astype(np.float64) * (2.0 * width) + (2.0 * low + (width - np.float64(1)))
    double_half = width.astype(np.float64) - 1.0
    most = float(np.abs(exact.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    wide = most * 4 * max(dim, 1) >= EXACT
    out_q, out_v, out_s = [], [], []
    for start in range(0, len(q), STEP_QUERIES):
        block = q[start : start + STEP_QUERIES]
        middle = block.astype(np.float64) @ double_middle.T
        slack = np.abs(block).astype(np.float64) @ double_half
        if wide:
            slack = slack + 1e-9 * most * (dim + 1)  # covers the rounding of both sums
        for row, (qid, question) in enumerate(zip(q_ids[start : start + STEP_QUERIES], block)):
            upper, sure = middle[row] + slack[row], middle[row] - slack[row]
            own = np.searchsorted(ids, qid)
            if own < n and ids[own] == qid:
                upper, sure = np.delete(upper, own), np.delete(sure, own)
                rest = np.delete(np.arange(n), own)
            else:
                rest = np.arange(n)
            if not len(rest):
                continue
            floor = -np.inf if len(rest) <= k else np.partition(sure, len(sure) - k)[len(sure) - k]
            near = np.flatnonzero(upper >= floor)
            near = near[np.argsort(-upper[near], kind="stable")]
            scores, read, step = np.zeros(0, object if wide else np.float64), 0, 4 * k
            while read < len(near):
                if read >= k:
                    kth = np.sort(scores)[len(scores) - k]
                    if upper[near[read]] < 2.0 * float(kth):
                        break
                more = near[read : read + step]
                scores = np.concatenate([scores, _exact_scores(question, exact[rest[more]], wide)])
                read, step = read + len(more), 2 * step
            found = ids[rest[near[:read]]]
            order = np.lexsort((found, -scores.astype(np.float64)))[:k] if not wide else np.array(
                sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))[:k])
            out_q += [int(qid)] * len(order)
            out_v += found[order].tolist()
            out_s += [int(s) for s in scores[order]]
    return out_q, out_v, out_s


def _build(key, table):
    dim, shard = (int(x.as_py()) for x in key)
    ids, vectors = distinct_ids(table["vec_id"].to_numpy(), matrix(table["vector"], dim, np.int64))
    file = {"dim": dim, "shard": shard, "n": len(ids), **build_file(ids, vectors)}
    types = {"dim": pa.int32(), "shard": pa.int32(), "n": pa.int32()}
    return pa.table({c: pa.array([v], types.get(c, pa.binary())) for c, v in file.items()})


def index_files(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of vectors(vec_id long, vector array<long>), written to the shared folder.

    Vectors of different length live in different shards and never meet. Rows that repeat an id count
    once."""
    shards = cells(vectors.count(), shard_rows)
    keyed = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), part("vec_id", shards).alias("shard"))
    return written(keyed.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "va-file")


def va_topk(queries: DataFrame, index: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the exact k largest inner products of each of
    queries(query_id long, vector array<long>) over the indexed vectors other than its own id; all of
    them if fewer. Ties go to the smaller vec_id; scores beyond a long are held at its ends."""
    blocks = cells(queries.count(), block_rows)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select("query_id", "vector", F.size("vector").alias("dim"), part("query_id", blocks).alias("block"))
    asked = asked.withColumn("shard", every_cell(shards))  # a question goes to every shard
    files = index.withColumn("block", every_cell(blocks))

    def search(key, questions, shard):
        found = ([], [], [])
        if questions.num_rows and shard.num_rows:
            dim = int(key[0].as_py())
            q_ids, q = distinct_ids(questions["query_id"].to_numpy(), matrix(questions["vector"], dim, np.int64))
            for row in shard.to_pylist():
                for kept, new in zip(found, search_file(row, q_ids, q, k)):
                    kept += new
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    local = asked.groupBy(*keys).cogroup(files.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    return ranked(local, k)
