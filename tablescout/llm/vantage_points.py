"""Approximate nearest neighbours by one vantage-point tree per shard.

Largest inner product becomes nearest point by one extra coordinate: with M the largest norm of a shard,
x gets sqrt(M^2 - |x|^2) and a question gets 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x. A branch whose
distance shell is at least `bound` away is left out when relax * bound exceeds the distance of the
k-th best so far. relax = 1 is exact search by the triangle inequality; larger values skip more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import written
from tablescout.llm.vector_grid import (
    BLOCK_ROWS, SHARD_ROWS, best_rows, cells, distinct_ids, every_cell, matrix, part, ranked,
)

LEAF_ROWS = 256
RELAX = 2.0
STEP_QUERIES = 256

_INDEX = "dim int, shard int, n int, ids binary, vectors binary, nodes binary, shells binary"


def build_tree(vectors: np.ndarray, leaf: int = LEAF_ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, nodes (start, end, near child, far child) and shells (near low, near high, far
    low, far high). The vantage point of a node is its first row; children split the others by median
    rank, so equal distances never make a branch grow without end. A leaf has no children (-1)."""
    norms = (vectors * vectors).sum(axis=1)
    top = norms.max(initial=0.0)
    points = np.column_stack([vectors, np.sqrt(np.maximum(top - norms, 0.0))])
    order, draw = np.arange(len(points)), np.random.default_rng(seed)
    nodes, shells, open_nodes = [[0, len(points), -1, -1]], [[0.0] * 4], [0]
    while open_nodes:
        at = open_nodes.pop()
        start, end = nodes[at][:2]
        if end - start <= leaf:
            continue
        pick = start + int(draw.integers(end - start))
        order[[start, pick]] = order[[pick, start]]
        rest = order[start + 1 : end]
        d = np.sqrt(((points[rest] - points[order[start]]) ** 2).sum(axis=1))
        half = len(rest) // 2
        split = np.argsort(d, kind="stable")
        order[start + 1 : end], d = rest[split], d[split]
        shells[at] = [d[0], d[half - 1], d[half], d[-1]]
        for side, (a, b) in enumerate(((start + 1, start + 1 + half), (start + 1 + half, end))):
            nodes[at][2 + side] = len(nodes)
            open_nodes.append(len(nodes))
            nodes.append([a, b, -1, -1])
            shells.append([0.0] * 4)
    return order, np.array(nodes, np.int32), np.array(shells, np.float64)


class _Search:
    """One block of questions walking one tree; the questions of a branch move together."""

    def __init__(self, row: dict, q_ids: np.ndarray, q: np.ndarray, k: int, relax: float):
        n, dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 4)
        self.shells = np.frombuffer(row["shells"], np.float64).reshape(-1, 4)
        self.top = float((self.vectors * self.vectors).sum(axis=1).max(initial=0.0))
        self.q_ids, self.q, self.k, self.relax = q_ids, q, k, relax
        self.norms = (q * q).sum(axis=1)
        self.slack = 1e-6 * (np.sqrt(self.norms) + np.sqrt(self.top))
        self.scores = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.reads = 0

    def _offer(self, who: np.ndarray, start: int, end: int) -> None:
        scores = self.q[who] @ self.vectors[start:end].T
        self.reads += scores.size
        ids = self.ids[start:end]
        scores[self.q_ids[who][:, None] == ids[None, :]] = -np.inf
        hit = (scores >= self.scores[who, -1][:, None]).any(axis=1)
        if hit.any():
            who, scores = who[hit], scores[hit]
            if scores.shape[1] > self.k:  # all that tie with the k-th stay in play
                floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
                width = int((scores >= floor[:, None]).sum(axis=1).max())
                if width < scores.shape[1]:
                    keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                    scores, ids = np.take_along_axis(scores, keep, 1), ids[keep]
            ids = np.broadcast_to(ids, scores.shape)
            both = np.concatenate([self.scores[who], scores], axis=1)
            names = np.concatenate([self.found[who], np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)], axis=1)
            self.scores[who], self.found[who] = best_rows(both, names, self.k)

    def _allowed(self, who: np.ndarray, d: np.ndarray, low: float, high: float) -> np.ndarray:
        kth = self.scores[who, -1]
        reach = np.where(np.isneginf(kth), np.inf, np.sqrt(np.maximum(self.norms[who] + self.top - 2 * np.where(np.isneginf(kth), 0, kth), 0.0)))
        bound = np.maximum(np.maximum(low - d, d - high), 0.0)
        return self.relax * bound <= reach + self.slack[who]

    def walk(self, node: int, who: np.ndarray) -> None:
        start, end, near, far = self.nodes[node]
        if near < 0:
            self._offer(who, start, end)
            return
        self._offer(who, start, start + 1)
        gap = self.norms[who] + self.top - 2 * (self.q[who] @ self.vectors[start])
        d = np.sqrt(np.maximum(gap, 0.0))
        a, b, c, e = self.shells[node]
        inside = d <= (b + c) / 2
        for side in (inside, ~inside):
            for child, low, high in ((near, a, b), (far, c, e)) if side is inside else ((far, c, e), (near, a, b)):
                go = side.copy()
                go[side] = self._allowed(who[side], d[side], low, high)
                if go.any():
                    self.walk(int(child), who[go])


def search_tree(row: dict, q_ids: np.ndarray, q: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for at in range(0, len(q), STEP_QUERIES):
        walk = _Search(row, q_ids[at : at + STEP_QUERIES], q[at : at + STEP_QUERIES], k, relax)
        walk.walk(0, np.arange(len(walk.q)))
        real = ~np.isneginf(walk.scores)
        parts.append((np.repeat(walk.q_ids, real.sum(axis=1)), walk.found[real], walk.scores[real]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _build(key, table):
    dim, shard = (int(x.as_py()) for x in key)
    ids, vectors = distinct_ids(table["vec_id"].to_numpy(), matrix(table["vector"], dim))
    order, nodes, shells = build_tree(vectors)
    row = {"dim": dim, "shard": shard, "n": len(ids), "ids": ids[order].tobytes(), "vectors": vectors[order].tobytes(),
           "nodes": nodes.tobytes(), "shells": shells.tobytes()}
    types = {"dim": pa.int32(), "shard": pa.int32(), "n": pa.int32()}
    return pa.table({c: pa.array([v], types.get(c, pa.binary())) for c, v in row.items()})


def index_trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One tree per shard of vectors(vec_id long, vector array<double>), written to the shared folder.
    Every row is indexed. Vectors of different length never meet; rows that repeat an id count once."""
    shards = cells(vectors.count(), shard_rows)
    keyed = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), part("vec_id", shards).alias("shard"))
    return written(keyed.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "vp-tree")


def vp_topk(queries: DataFrame, index: DataFrame, k: int, relax: float = RELAX, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each of
    queries(query_id long, vector array<double>), its own id left out; all others if fewer. Ties go to
    the smaller vec_id. relax = 1 is exact."""
    if relax < 1:
        raise ValueError("relax must be at least 1")
    blocks = cells(queries.count(), block_rows)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select("query_id", "vector", F.size("vector").alias("dim"), part("query_id", blocks).alias("block"))
    asked = asked.withColumn("shard", every_cell(shards))  # a question goes to every shard
    trees = index.withColumn("block", every_cell(blocks))

    def search(key, questions, shard):
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if questions.num_rows and shard.num_rows:
            q_ids, q = distinct_ids(questions["query_id"].to_numpy(), matrix(questions["vector"], int(key[0].as_py())))
            parts = [search_tree(row, q_ids, q, k, relax) for row in shard.to_pylist()]
            found = tuple(np.concatenate(x) for x in zip(*parts))
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    local = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    return ranked(local, k)
