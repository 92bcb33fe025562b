"""Greedy packing of ordered text pieces into token-limited blocks, without one-task groups.

The greedy rule is sequential: a piece joins the open block while the token sum stays
below the limit. A table with very many pieces is cut into chunks. Each chunk is
summarised as a function from "tokens in the open block" to "tokens in the open block",
the functions of one table are composed pairwise in rounds, and then every chunk assigns
its pieces knowing what it was handed. The result is exactly the sequential one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.operators.scaling import ranked
from tablescout.session import materialize

CHUNK = 65_536


def _jumps(n: np.ndarray, limit: int, gap: int):
    """Prefix sums of piece weights and, per start, the first piece of the following block."""
    prefix = np.concatenate([[0], np.cumsum(n + gap)])
    first_too_many = np.searchsorted(prefix, prefix[:-1] + gap + limit, side="left") - 1
    return prefix, np.maximum(first_too_many, np.arange(1, len(n) + 1))


def _entry_end(prefix: np.ndarray, state: int, limit: int) -> int:
    """First piece that does not join the open block handed over (state 0: no open block)."""
    if state == 0:
        return 0
    return int(np.searchsorted(prefix[1:], limit - (state - 1), side="left"))


def chunk_function(n: np.ndarray, limit: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every open-block state: the state after the chunk and the blocks begun in it.

    State 0 means no open block; state s means s-1 tokens, capped at `limit`."""
    m = len(n)
    prefix, jump = _jumps(n, limit, gap)
    end = np.zeros(m + 1, dtype=np.int64)
    begun = np.zeros(m + 1, dtype=np.int64)
    for i in range(m - 1, -1, -1):
        j = jump[i]
        if j >= m:
            end[i], begun[i] = 1 + min(prefix[m] - prefix[i] - gap, limit), 1
        else:
            end[i], begun[i] = end[j], begun[j] + 1
    states = np.arange(limit + 2)
    out_end, out_begun = np.zeros(limit + 2, dtype=np.int64), np.zeros(limit + 2, dtype=np.int64)
    for s in states:
        p = _entry_end(prefix, int(s), limit)
        if p >= m:
            out_end[s] = 1 + min(s - 1 + prefix[m], limit)
        else:
            out_end[s], out_begun[s] = end[p], begun[p]
    return out_end, out_begun


def assign_chunk(n: np.ndarray, state: int, limit: int, gap: int) -> np.ndarray:
    """Block number of every piece, relative to the block open at entry (number -1)."""
    prefix, jump = _jumps(n, limit, gap)
    block = np.full(len(n), -1, dtype=np.int64)
    at, number = _entry_end(prefix, state, limit), 0
    while at < len(n):
        block[at : jump[at]] = number
        at, number = jump[at], number + 1
    return block


def chunk_entries(functions: DataFrame, group: list[str]) -> DataFrame:
    """(group, _chunk, _state, _offset): the state in which every chunk begins and the blocks begun before it.

    functions(group, _chunk, _f). An associative scan: neighbours are composed pairwise, round by round, up to one
    function per group, and the way down hands every pair its entry, the right one by way of the left one. No row or
    group ever holds more than two functions; a group of c chunks takes log2(c) rounds each way."""
    longs = T.ArrayType(T.LongType())

    @F.pandas_udf(T.StructType([T.StructField("end", longs), T.StructField("begun", longs)]))
    def composed(left: pd.Series, left_begun: pd.Series, right: pd.Series, right_begun: pd.Series) -> pd.DataFrame:
        out = [(np.asarray(f)[e], b + np.asarray(g)[e]) for e, b, f, g in zip(left, left_begun, right, right_begun)]
        return pd.DataFrame({"end": [o[0] for o in out], "begun": [o[1] for o in out]})

    level = materialize(ranked(materialize(functions, "pack-functions"), group, [F.col("_chunk")], "_i", size="_m"), "pack-level")
    names, most = level.select(*group, "_chunk", "_i"), level.agg(F.max("_m")).first()[0] or 1
    level, pairs = level.select(*group, "_i", "_f"), []
    for _ in range(int(most - 1).bit_length()):
        two = level.groupBy(*group, F.shiftright("_i", 1).alias("_i")).agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), "_f"))).alias("_two"))
        left, right = F.col("_two")[0]["_f"], F.get("_two", F.lit(1))["_f"]
        pairs.append(materialize(two.select(*group, "_i", left.alias("_left"), right.alias("_right")), "pack-pairs"))
        both = pairs[-1].where("_right is not null")
        joined = both.select(*group, "_i", composed("_left.end", "_left.begun", "_right.end", "_right.begun").alias("_f"))
        level = joined.unionByName(pairs[-1].where("_right is null").select(*group, "_i", F.col("_left").alias("_f")))
    zero = F.lit(0).cast("long")
    entries = names.where("_i = 0").select(*group, "_i", zero.alias("_state"), zero.alias("_offset"))
    for pair in reversed(pairs):
        state = F.col("_state").cast("int")
        same = F.struct((F.col("_i") * 2).alias("_i"), "_state", "_offset")
        then = F.struct((F.col("_i") * 2 + 1).alias("_i"), F.get("_left.end", state).alias("_state"), (F.col("_offset") + F.get("_left.begun", state)).alias("_offset"))
        below = pair.join(entries, [*group, "_i"]).select(
            *group, F.explode(F.array_compact(F.array(same, F.when(F.col("_right").isNotNull(), then)))).alias("_e")
        )
        entries = materialize(below.select(*group, "_e.*"), "pack-entries")
    return names.join(entries, [*group, "_i"]).drop("_i")


def assign_blocks(
    pieces: DataFrame, group: list[str], order: str, tokens: str, limit: int, gap: int = 1, chunk: int = CHUNK
) -> DataFrame:
    """(group, order, block): block number of every piece, from 0 per group.

    `order` is a unique integer inside the group. Only integers are moved here; one row
    holds the token counts of at most `chunk` consecutive pieces."""
    cut = F.floor(F.col(order) / F.lit(chunk)).cast("long").alias("_chunk")
    chunks = (
        pieces.select(*group, cut, F.struct(F.col(order).cast("long").alias("o"), F.col(tokens).cast("long").alias("n")).alias("_p"))
        .groupBy(*group, "_chunk")
        .agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        .select(*group, "_chunk", F.transform("_p", lambda p: p["o"]).alias("_o"), F.transform("_p", lambda p: p["n"]).alias("_n"))
    )
    # Groups of one chunk start with no open block; only longer ones need their chunks chained.
    long_groups = (
        pieces.select(*group, cut).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    )
    longs = T.ArrayType(T.LongType())

    @F.pandas_udf(T.StructType([T.StructField("end", longs), T.StructField("begun", longs)]))
    def describe(n: pd.Series) -> pd.DataFrame:
        both = [chunk_function(np.asarray(x), limit, gap) for x in n]
        return pd.DataFrame({"end": [e for e, _ in both], "begun": [b for _, b in both]})

    @F.pandas_udf(longs)
    def place(n: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([assign_chunk(np.asarray(x), int(s), limit, gap) for x, s in zip(n, state)])

    first, last = pieces.agg(F.min(cut), F.max(cut)).first()
    if first == last:  # no group has a second chunk
        entries = None
    else:
        functions = chunks.join(long_groups, group, "left_semi").select(*group, "_chunk", describe("_n").alias("_f"))
        entries = chunk_entries(functions, group)
    entered = chunks.withColumns({"_state": F.lit(0).cast("long"), "_offset": F.lit(0).cast("long")}) if entries is None else (
        chunks.join(entries, [*group, "_chunk"], "left")
    )
    placed = entered.select(
        *group, "_o", F.coalesce("_offset", F.lit(0)).alias("_offset"), place("_n", F.coalesce("_state", F.lit(0))).alias("_b")
    )
    return placed.select(*group, "_offset", F.explode(F.arrays_zip("_o", "_b")).alias("_z")).select(
        *group, F.col("_z._o").alias(order), (F.col("_z._b") + F.col("_offset")).alias("block")
    )


def pack_blocks(
    pieces: DataFrame, group: list[str], order: str, text: str, tokens: Column, limit: int = 512,
    separator: str = " || ", gap: int = 1, source: str | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Blocks (group, block, text, n_tokens, n_pieces[, source_ids]).

    A piece joins while the tokens of the joined text stay strictly below `limit`;
    an oversized piece stays alone. A block holds fewer than `limit` pieces, so
    joining its texts is bounded."""
    counted = pieces.withColumn("_tokens", tokens).withColumn(order, F.col(order).cast("long"))
    placed = assign_blocks(counted, group, order, "_tokens", limit, gap, chunk)
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    outputs = [
        F.array_join(F.transform(in_order, lambda x: x["t"]), separator).alias("text"),
        (F.sum("_tokens") + F.lit(gap) * (F.count(F.lit(1)) - 1)).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_pieces"),
    ]
    if source:
        by = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s"))))
        outputs.append(F.transform(by, lambda x: x["s"]).alias("source_ids"))
    return counted.join(placed, [*group, order]).groupBy(*group, "block").agg(*outputs)
