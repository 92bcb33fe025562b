"""Prefix trie of conversations from their sorted order, without a stack.

A conversation is a path: 20 bytes a turn, the MD5 of role and text and the text's length. Paths are sorted, cut into
blocks, and a block holds the LCP (turns shared with the path before) of each. A sparse table gives the least LCP of
any stretch, so every prefix of every path finds the first and the last path that share it by two binary searches of
its own; the interval's first path stands for the node, and sums and minima over the interval are its members' figures.

Equal conversations are one path with a count. A node that reaches over a block's border is known by the MD5 of its
prefix, and the parts that its blocks report are added. Two different turns meet with a chance of 2^-128 a pair.

Rows without a conv_id belong to no conversation. A null role or text counts as empty; turns sort by `turn` (null
first), equal ones by their MD5; repeated rows are turns of their own. An empty table has no node, not even the root.
One conversation's path must fit a task (20 bytes a turn); texts never move."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import written

TURN = 20
BLOCK_TURNS = 1_000_000
LEAST_TURNS = 4_096
_NODES = (
    "block long, key string, depth long, low long, parent_key string, parent_low long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends string"
)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    record = F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), record.alias("record")).alias("at")
    )
    ordered = F.sort_array(F.collect_list("at"))["record"]
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("path"))


def cut(path: Column, first: Column | int, turns: Column | int | None = None) -> Column:
    """Turns of a path from `first` (0-based) on, `turns` of them or all."""
    at = F.lit(first) * TURN + 1
    return F.substr(path, at) if turns is None else F.substr(path, at, F.lit(turns) * TURN)


def with_shared_heads(paths: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """Every conversation with its first `head` turns (at most `most`) replaced by those of conversation `base`: fewer
    if that one has fewer, none if it is absent."""
    own = paths.select("conv_id", "path", head.cast("int").alias("_head"), base.alias("_base"))
    wanted = own.select(F.col("_base").alias("conv_id")).distinct()
    heads = paths.join(wanted, "conv_id", "left_semi").select(
        F.col("conv_id").alias("_base"), cut(F.col("path"), 0, most).alias("_first")
    )
    path = F.concat(F.coalesce(cut(F.col("_first"), 0, F.col("_head")), F.lit(b"")), cut(F.col("path"), F.col("_head")))
    return own.join(heads, "_base", "left").select("conv_id", path.alias("path"))


# ---- digests of the conversations that end at a node


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_pylist()
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        runs = list(zip(edges, edges[1:]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[a] for a, _ in runs]), pa.array([int(ids[a]) for a, _ in runs], pa.int64()),
             pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in runs])], ["key", "first", "ids"]
        )


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(text.encode())
        yield _digest_batch(done)
    if key is not None:
        yield _digest_batch([(key, state.hexdigest())])


def _digest_batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["key", "ends"])


def id_digests(keyed: DataFrame, parts: int) -> DataFrame:
    """(key, ends): SHA-256 of each key's conv_ids, ascending, comma-joined. Ids of a hot key are sorted and joined in
    many tasks; the last step streams those stretches of text through one digest and holds one at a time."""
    runs = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _id_runs, "key string, first long, ids string"
    )
    return runs.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_id_digests, "key string, ends string")


# ---- one block of sorted paths


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the least of every 2^k consecutive values."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        low = levels[-1]
        levels.append(np.minimum(low[:-width], low[width:]))
        width *= 2
    return levels


def range_min(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of each stretch first..last (both included, not empty)."""
    out = np.empty(len(first), levels[0].dtype)
    depth = np.log2(last - first + 1).astype(int)
    for k in np.unique(depth):
        at = depth == k
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << int(k)) + 1])
    return out


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first `depth` turns of `row`, by a binary search on either side."""
    n = len(levels[0])
    low, left = np.zeros_like(row), row.copy()
    while (open_ := np.flatnonzero(low < left)).size:
        mid = (low[open_] + left[open_]) // 2
        shared = range_min(levels, mid + 1, row[open_]) >= depth[open_]
        left[open_] = np.where(shared, mid, left[open_])
        low[open_] = np.where(shared, low[open_], mid + 1)
    right, high = row.copy(), np.full_like(row, n - 1)
    while (open_ := np.flatnonzero(right < high)).size:
        mid = (right[open_] + high[open_] + 1) // 2
        shared = range_min(levels, row[open_] + 1, mid) >= depth[open_]
        right[open_] = np.where(shared, mid, right[open_])
        high[open_] = np.where(shared, high[open_], mid - 1)
    return left, right


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    most = min(len(a), len(b)) // TURN
    if a[: most * TURN] == b[: most * TURN]:
        return most
    x, y = (np.frombuffer(p, np.uint8, most * TURN).reshape(most, TURN) for p in (a, b))
    return int(np.argmax((x != y).any(axis=1)))


def _neighbour_lcps(records: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shared turns of each path with the one before it; 0 for the first."""
    out = np.zeros(len(size), np.int64)
    both = np.minimum(size[1:], size[:-1])
    at = np.flatnonzero(both)
    if not len(at):
        return out
    edge = np.concatenate([[0], np.cumsum(both[at])[:-1]])
    inside = np.arange(both[at].sum()) - np.repeat(edge, both[at])
    differ = (records[np.repeat(start[at], both[at]) + inside] != records[np.repeat(start[at + 1], both[at]) + inside]).any(axis=1)
    out[at + 1] = np.minimum(both[at], np.minimum.reduceat(np.where(differ, inside, np.iinfo(np.int64).max), edge))
    return out


def _prefix_keys(path: bytes, most: int) -> list[str]:
    """MD5 of the first 0..most turns."""
    state, keys = hashlib.md5(), []
    for d in range(most + 1):
        keys.append(state.hexdigest())
        state.update(path[d * TURN : (d + 1) * TURN])
    return keys


def block_nodes(paths: list[bytes], convs: np.ndarray, lows: np.ndarray, before: bytes | None, after: bytes | None) -> dict:
    """The nodes of sorted distinct paths, one row each. `before` and `after` are the paths next to the block; a node
    that one of them shares is a part of a node and carries its prefix key."""
    size = np.array([len(p) // TURN for p in paths], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    records = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, TURN)
    lcp = _neighbour_lcps(records, start, size)
    lcp[0] = -1 if before is None else shared_turns(before, paths[0])
    last_lcp = -1 if after is None else shared_turns(after, paths[-1])
    chars = np.concatenate([[0], np.cumsum(records[:, TURN - 4 :].copy().view(">u4").ravel().astype(np.int64))])
    upto = lambda row, depth: chars[start[row] + depth] - chars[start[row]]  # noqa: E731  text length of the first turns
    rows = np.arange(len(paths))
    whole = upto(rows, size)
    cumulate = lambda x: np.concatenate([[0], np.cumsum(x)])
    w_sum, text_sum = cumulate(convs), cumulate(convs * whole)
    leaf_sum = cumulate(np.append(lcp[1:], last_lcp) < size)
    born_sum = cumulate(whole - upto(rows, np.maximum(lcp, 0)))
    lcps, low_table = sparse_table(lcp), sparse_table(lows)
    by_lcp = np.sort(np.maximum(lcp, 0) * (len(paths) + 1) + rows)
    by_lcp = by_lcp[by_lcp % (len(paths) + 1) > 0]  # the first row's LCP lies outside

    row = np.repeat(rows, size + 1)
    depth = np.arange(len(row)) - np.repeat(start + rows, size + 1)
    left, right = extents(lcps, row, depth)
    mine = left == row  # every other prefix found the same node from another of its members
    row, depth, right = row[mine], depth[mine], right[mine]
    born = lcp[row] < depth
    above = np.maximum(depth - 1, 0)
    parent_left, parent_right = extents(lcps, row, above)

    between = lambda sums, a, b: sums[b + 1] - sums[a]
    n_convs = between(w_sum, row, right)
    gained = np.where(born, whole[row] - upto(row, above), whole[row] - upto(row, np.maximum(lcp[row], 0)))
    saved = between(text_sum, row, right) - n_convs * upto(row, above) - gained - between(born_sum, row + 1, right)
    of = lambda r: depth * (len(paths) + 1) + r
    starts_child = np.where(born, size[row] > depth, lcp[row] == depth)
    n_children = np.searchsorted(by_lcp, of(right), "right") - np.searchsorted(by_lcp, of(row), "right") + starts_child

    first_keys = _prefix_keys(paths[0], max(int(lcp[0]), -1))
    last_keys = _prefix_keys(paths[-1], max(last_lcp, -1))

    def keys(a, b, d, real):
        return [
            None if not r else first_keys[k] if i == 0 and k <= lcp[0] else last_keys[k] if j == len(paths) - 1 and k <= last_lcp else None
            for i, j, k, r in zip(a.tolist(), b.tolist(), d.tolist(), real.tolist())
        ]

    real = np.ones(len(row), bool)
    return {
        "key": keys(row, right, depth, real), "depth": depth, "low": range_min(low_table, row, right),
        "parent_key": keys(parent_left, parent_right, above, depth > 0),
        "parent_low": range_min(low_table, parent_left, parent_right), "n_convs": n_convs,
        "n_children": n_children, "n_leaves": between(leaf_sum, row, right), "saved": saved,
        "end_row": np.where(born & (size[row] == depth), row, -1),
    }


def _nodes_of_block(block: pa.Table, borders: pa.Table) -> pa.Table:
    paths = block.column("path").to_pylist()
    order = sorted(range(len(paths)), key=paths.__getitem__)
    block = block.take(pa.array(order, pa.int64()))
    found = block_nodes(
        [paths[i] for i in order], block.column("n").to_numpy(), block.column("low").to_numpy(),
        borders.column("before")[0].as_py(), borders.column("after")[0].as_py(),
    )
    ends = block.column("ends").combine_chunks()
    end_row = found.pop("end_row")
    found["ends"] = ends.take(pa.array(end_row, mask=end_row < 0))
    found["block"] = np.full(len(end_row), block.column("block")[0].as_py())
    names = [f.split()[0] for f in _NODES.split(", ")]
    kinds = {"key": pa.string(), "parent_key": pa.string(), "ends": pa.string()}
    return pa.table({n: pa.array(found[n], kinds.get(n, pa.int64())) if not isinstance(found[n], pa.Array) else found[n] for n in names})


# ---- the whole trie


def prefix_nodes(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of paths(conv_id, path): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = written(paths, "trie-paths")
    alike = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    turns = paths.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    turns //= TURN
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-turns // block_turns), min(cores, -(-turns // min(LEAST_TURNS, block_turns))))
    ends = id_digests(paths.select(F.md5("path").alias("key"), "conv_id"), parts)
    alike = alike.withColumn("key", F.md5("path")).join(ends, "key").drop("key")
    blocks = written(
        alike.repartitionByRange(parts, "path").withColumn("block", F.spark_partition_id().cast("long")), "trie-blocks"
    )
    edges = written(blocks.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last")), "trie-edges")
    present = sorted(r[0] for r in edges.select("block").collect())  # as many numbers as tasks, no rows
    beside = spark.createDataFrame(list(zip(present, [None, *present], [*present[1:], None])), "block long, left long, right long")
    borders = (
        beside.join(edges.select(F.col("block").alias("left"), F.col("last").alias("before")), "left", "left")
        .join(edges.select(F.col("block").alias("right"), F.col("first").alias("after")), "right", "left")
        .select("block", "before", "after")
    )
    nodes = written(blocks.groupBy("block").cogroup(borders.groupBy("block")).applyInArrow(_nodes_of_block, _NODES), "trie-nodes")

    parts_ = nodes.where("key is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    joined = written(
        parts_.groupBy("key").agg(
            F.first("depth").alias("depth"), F.min("low").alias("low"), F.first("parent_key").alias("parent_key"), *sums, F.max("ends").alias("ends")
        ),
        "trie-joined",
    )
    lows = joined.select(F.col("key").alias("parent_key"), F.col("low").alias("parent"))
    homes = parts_.select("block", F.col("key").alias("parent_key")).distinct().join(lows, "parent_key")
    own = nodes.where("key is null")
    found = [
        own.where("parent_key is null").withColumn("parent", F.when(F.col("depth") > 0, F.col("parent_low"))),
        own.where("parent_key is not null").join(homes, ["block", "parent_key"]),
        joined.join(lows, "parent_key", "left"),
    ]
    columns = ["low", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    every = found[0].select(columns).unionByName(found[1].select(columns)).unionByName(found[2].select(columns))
    return every.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
