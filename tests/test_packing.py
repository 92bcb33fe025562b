import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout.operators.packing import assign_blocks, assign_chunk, chunk_function, pack_blocks


def sequential(tokens, limit, gap=1):
    blocks, open_tokens, block = [], None, -1
    for n in tokens:
        if open_tokens is not None and open_tokens + gap + n < limit:
            open_tokens += gap + n
        else:
            block, open_tokens = block + 1, n
        blocks.append(block)
    return blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=1, max_size=60), st.integers(2, 20), st.integers(1, 9))
def test_chained_chunks_equal_the_sequential_rule(tokens, limit, size):
    state, offset, got = 0, 0, []
    for at in range(0, len(tokens), size):
        part = np.array(tokens[at : at + size])
        got += list(assign_chunk(part, state, limit, 1) + offset)
        end, begun = chunk_function(part, limit, 1)
        state, offset = int(end[state]), offset + int(begun[state])
    assert got == sequential(tokens, limit)


def test_one_group_over_many_chunks(spark):
    rng = random.Random(3)
    data = [("hot", i, rng.randint(0, 12)) for i in range(500)] + [("cold", i, rng.randint(0, 12)) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o long, n int")
    rows = assign_blocks(df, ["g"], "o", "n", 20, 1, chunk=16).collect()
    for g in ("hot", "cold"):
        got = [r["block"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["o"])]
        assert got == sequential([n for k, _, n in data if k == g], 20)


def test_a_thousand_chunks_equal_the_sequential_rule(spark):
    """Sparse order numbers, a second group with gaps, and one group of a single chunk."""
    rng = random.Random(8)
    orders = {"hot": sorted(rng.sample(range(12_000), 6_000)), "gaps": [i for i in range(900) if (i // 50) % 3], "one": [5]}
    data = [(g, o, rng.randint(0, 9)) for g, some in orders.items() for o in some]
    rows = assign_blocks(spark.createDataFrame(data, "g string, o long, n int"), ["g"], "o", "n", 17, 1, chunk=6).collect()
    for g in orders:
        got = [r["block"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["o"])]
        assert got == sequential([n for k, _, n in data if k == g], 17)


def test_limit_is_strict_and_oversized_pieces_stay_alone(spark):
    def pack(*texts, limit):
        df = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "g string, o long, s string")
        n = F.size(F.split("s", " "))
        return [r["text"] for r in pack_blocks(df, ["g"], "o", "s", n, limit).orderBy("block").collect()]

    assert pack("a b", "c", limit=4) == ["a b", "c"]  # 2 + 1 + 1 is not below 4
    assert pack("a b", "c", limit=5) == ["a b || c"]
    assert pack("a", "b c d e f g", "h", limit=5) == ["a", "b c d e f g", "h"]
    assert pack("only", limit=5) == ["only"]
