"""Prefix trie and Merkle manifest against brute force, with odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import prefix_trie
from tablescout.llm.merkle_manifest import SPAN, build_manifest, field_text, fold, leaf_digest, path_digest, proofs
from tablescout.llm.prefix_trie import TURN, block_nodes, extents, prefix_nodes, range_min, sparse_table, turn_paths, with_shared_heads
from tablescout.llm.queries import QUERIES

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()

# ---- prefix trie


def plain_trie(talks):
    """{conv_id: [(role, text)]} -> the rows of every node, straight from their definition."""
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p] + [q for k in kids.get(p, []) for q in below(k)]

    out = set()
    for p, cs in members.items():
        under = below(p)
        ends = ",".join(map(str, sorted(c for c in cs if len(talks[c]) == len(p))))
        out.add((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])),
            sum(q not in kids for q in under), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), SHA(ends),
        ))
    return out


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, path string, n_convs string")


def nodes_of(df):
    return {tuple(r) for r in df.collect()}


def random_talks(seed, n, longest=6):
    draw = random.Random(seed)
    turns = [("user", "hi"), ("user", ""), ("bot", "héllo 😀"), ("", "x"), ("user", "hi there")]
    return {c: [turns[0]] * draw.choice([0, 1, 1]) + [draw.choice(turns) for _ in range(draw.randint(0, longest))] for c in draw.sample(range(-50, 5000), n)}


def test_sparse_table_and_extents():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 65):
        values = draw.integers(0, 4, n)
        levels = sparse_table(values)
        a, b = np.array([(i, j) for i in range(n) for j in range(i, n)]).T
        assert (range_min(levels, a, b) == [values[i : j + 1].min() for i, j in zip(a, b)]).all()
        row, depth = np.array([(i, d) for i in range(n) for d in range(5)]).T
        left, right = extents(levels, row, depth)
        for i, d, x, y in zip(row, depth, left, right):
            lo = hi = i
            while lo > 0 and values[lo] >= d:
                lo -= 1
            while hi + 1 < n and values[hi + 1] >= d:
                hi += 1
            assert (x, y) == (lo, hi)


@pytest.mark.parametrize("block_turns", [5, 40, 10_000])
def test_trie_against_brute_force(spark, block_turns):
    """Nodes over many block borders, copies, a turnless conversation, nulls."""
    talks = random_talks(block_turns, 60) | {6000: []} | {7000 + i: [("user", "hi"), ("bot", "same")] for i in range(25)}
    rows = [(c, i, r or None, t or None, "x", "y") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    paths = turn_paths(conversations(spark, rows))
    empty = spark.createDataFrame([(c,) for c, t in talks.items() if not t], "conv_id long").withColumn("path", F.lit(b""))
    assert nodes_of(prefix_nodes(paths.unionByName(empty), block_turns)) == plain_trie(talks)


def test_heads_come_from_the_base(spark):
    talks = {100: [("u", "a"), ("b", "b")], 101: [("u", "c"), ("b", "d"), ("u", "e")], 205: [("u", "z")], 199: [("u", "q")]}
    rows = [(c, i, r, t, "", "") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    head = F.when(F.col("conv_id") == 199, 1).otherwise(3)
    built = with_shared_heads(turn_paths(conversations(spark, rows)), head, F.col("conv_id") - F.col("conv_id") % 100, 5)
    want = {100: talks[100], 101: talks[100], 205: [], 199: talks[100][:1]}
    assert nodes_of(prefix_nodes(built)) == plain_trie(want)


def test_trie_of_odd_tables(spark):
    """Null turns first, ties by content, repeats as turns of their own, rows without id left out, empty table."""
    rows = [(1, 2, "u", "last", "", ""), (1, None, "u", "first", "", ""), (1, 1, "u", "twice", "", ""), (1, 1, "u", "twice", "", ""),
            (None, 0, "u", "gone", "", ""), (2, None, None, None, "", "")]
    want = {1: [("u", "first"), ("u", "twice"), ("u", "twice"), ("u", "last")], 2: [("", "")]}
    df = conversations(spark, rows)
    assert nodes_of(prefix_nodes(turn_paths(df))) == plain_trie(want)
    assert prefix_nodes(turn_paths(df.where("conv_id is null"))).count() == 0


def test_long_conversation_in_one_block():
    """50,000 turns: one node a turn, and the figures of the whole chain."""
    path = b"".join(hashlib.md5(str(i).encode()).digest() + (7).to_bytes(4, "big") for i in range(50_000))
    got = block_nodes([path[: 20_000 * TURN], path], np.array([2, 1]), np.array([9, 4]), None, None)
    assert len(got["depth"]) == 50_001 and got["n_leaves"].tolist() == [1] * 50_001
    assert got["saved"][0] == 2 * 7 * 20_000 and got["n_convs"][20_001] == 1 and got["low"][0] == 4


def test_ids_of_a_hot_key_stream(spark, monkeypatch):
    rows = [("a", i) for i in random.Random(2).sample(range(10**6), 3000)] + [("b", 5)]
    got = dict(prefix_trie.id_digests(spark.createDataFrame(rows, "key string, conv_id long"), 7).collect())
    assert got == {"a": SHA(",".join(str(i) for _, i in sorted(rows[:-1]))), "b": SHA("5")}


# ---- Merkle manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_levels(level):
    levels = [level]
    while len(level) > 1:
        level = [SHA("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        first = at - at % 3
        path.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return path


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(map(field, r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    levels = {s: plain_levels([leaf(r) for r in t]) for s, t in trees.items()}
    top = plain_levels([levels[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            path = plain_path(levels[s], i) + plain_path(top, n)
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            at = leaf(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
            for before, after in path:
                at = SHA("".join(before) + at + "".join(after))
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], SHA("".join("".join(b + a) for b, a in path)), at, at == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n, seed):
    draw = random.Random(seed)
    text = lambda: draw.choice([None, "", "a\nb", "plain", "é\n😀\n", "x" * 5000 + "\n"])
    some = [(i * 7, draw.choice(["hot", "hot", "s1", "ü", "", None]), draw.choice(["en", None]), draw.choice([3, None]), text()) for i in range(n)]
    return some + some[:2] + [(None, "s1", None, None, "a\nb"), (None, "s1", None, None, None), (-4, "lone", "en", 1, "one\n")]


@pytest.mark.parametrize("n", [0, 4, 90, 260])
def test_manifest_query_against_brute_force(spark, tmp_path, n):
    """Trees of one to five levels (above and below a checkpoint), repeated and null ids, null and empty sources."""
    rows = manifest_rows(n, n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("digest", F.lit(1)).withColumn("path", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def test_manifest_stores_every_third_level_and_proofs_hold(spark):
    df = spark.range(SPAN * SPAN + 5).select(F.col("id").alias("k"), F.lit("s").alias("s"), F.lit(2).alias("tree"), F.lit(1).alias("root"))
    manifest = build_manifest(df, ["k", "tree"], "s", "k", {"k": F.col("k")})
    assert [m.count() for m in manifest.levels] == [SPAN * SPAN + 5, SPAN + 1, 2, 1] and len(manifest.top) == 1
    told = proofs(manifest).withColumn("up", fold(F.col("digest"), F.col("path")))
    assert told.where(F.col("up") != manifest.root).count() == 0 and told.count() == SPAN * SPAN + 5
    wrong = told.where(fold(leaf_digest([F.lit("x")]), F.col("path")) == manifest.root)
    assert wrong.count() == 0 and told.select(path_digest(F.col("path"))).distinct().count() > SPAN


def test_empty_manifest(spark):
    df = spark.createDataFrame([], "k long, s string")
    manifest = build_manifest(df, ["k"], "s", "k", {"k": F.col("k")})
    assert manifest.root is None and proofs(manifest).count() == 0
    assert spark.range(1).select(field_text(F.lit(None).cast("string"))).first()[0] == "-"
