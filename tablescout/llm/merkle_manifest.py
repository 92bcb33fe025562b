"""Merkle manifest of a table: one tree of three-way nodes per source, and one over the sources' roots.

The manifest stores the nodes of every third level only (a checkpoint). A proof needs all levels: an aligned subtree
of 27 stored nodes gives its missing 9 + 3 interior nodes back, which live in one row while the siblings of its 27
nodes are read off and are never stored.

A digest is lower-case hex SHA-256; a node is the digest of the hex texts of its children. A level of one node is the
root of its tree: it is not hashed again, so a lone leaf is the root itself. Rows sort by key (null first), equal keys
by leaf digest; rows that repeat are leaves of their own. A null source is a tree of its own and sorts first. An empty
table has an empty manifest without root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import written
from tablescout.operators.scaling import ranked

WAYS = 3
STEP = 3
SPAN = WAYS**STEP


def field_text(value: Column) -> Column:
    """Self-delimiting text of a value: UTF-8 byte count, colon, value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row's values in their order."""
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


@dataclass
class Manifest:
    """levels[k]: the stored checkpoint k with tree, place, n_nodes (of its tree there) and digest; levels[0] also has
    `row`. top: the same over the roots of the trees. root: the digest over all, None without rows."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _parents(digests: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / WAYS).cast("int")),
        lambda run: F.sha2(F.concat_ws("", F.slice(digests, run * WAYS + 1, F.lit(WAYS))).cast("binary"), 256),
    )


def _level_nodes(n_nodes: Column, height: int) -> Column:
    """Nodes of a whole tree `height` levels above a level of n_nodes."""
    for _ in range(height):
        n_nodes = F.ceil(n_nodes / WAYS)
    return n_nodes.cast("long")


def _with_interior(groups: DataFrame) -> DataFrame:
    """Adds l1..l3, the nodes above the at most 27 digests l0 of an aligned subtree. A level at which the whole tree
    has one node already stands for itself."""
    for i in range(STEP):
        low = F.col(f"l{i}")
        groups = groups.withColumn(f"l{i + 1}", F.when(_level_nodes(F.col("n_nodes"), i) > 1, _parents(low)).otherwise(low))
    return groups


def _subtrees(level: DataFrame, carry: list[str]) -> DataFrame:
    """One row per aligned subtree: `nodes` (place, digest and `carry` of its stored nodes, in order) and l0..l3."""
    node = F.struct("place", "digest", *[F.col(c) for c in carry])
    groups = level.groupBy("tree", F.floor(F.col("place") / SPAN).alias("above"), "n_nodes").agg(
        F.array_sort(F.collect_list(node), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("nodes")
    )
    return _with_interior(groups.withColumn("l0", F.col("nodes.digest")))


def _checkpoints(leaves: DataFrame, name: str) -> list[DataFrame]:
    levels = [leaves]
    most = leaves.agg(F.max("n_nodes")).first()[0] or 0
    while most > 1:
        above = _subtrees(levels[-1], []).select(
            "tree", F.col("above").alias("place"), _level_nodes(F.col("n_nodes"), STEP).alias("n_nodes"), F.col("l3")[0].alias("digest")
        )
        levels.append(written(above, f"{name}-{len(levels)}"))
        most = -(-most // SPAN)
    return levels


def build_manifest(df: DataFrame, columns: list[str], source: str, key: str, keep: dict[str, Column]) -> Manifest:
    """Manifest of the rows of `df`: a leaf digests `columns`; `keep` are the values (in `row`) that go along with a
    leaf to its proof. Texts are read once; what is sorted and stored is digests and kept values."""
    leaves = df.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"), F.struct(*[v.alias(n) for n, v in keep.items()]).alias("row"),
    )
    order = [F.col("key").asc_nulls_first(), F.col("digest")]
    placed = ranked(written(leaves, "manifest-rows"), ["source"], order, "place", start="tree", size="n_nodes")
    levels = _checkpoints(written(placed, "manifest-0"), "manifest")
    # `tree` counts the rows of earlier sources, so trees ascend as their sources do
    roots = ranked(levels[-1].select(F.col("tree").alias("member"), "digest"), [], [F.col("member")], "place", size="n_nodes")
    top = _checkpoints(written(roots.withColumn("tree", F.lit(0).cast("long")), "manifest-top-0"), "manifest-top")
    last = top[-1].first()
    return Manifest(levels, top, last["digest"] if last else None)


def _siblings(i: int) -> Column:
    """before and after: digests of the run's other nodes at interior level i for the node `at` (0 to 26)."""
    at = F.floor(F.col("at") / WAYS**i).cast("int")
    low, inside = F.col(f"l{i}"), at % WAYS
    return F.struct(
        F.concat_ws("", F.slice(low, at - inside + 1, inside)).alias("before"),
        F.concat_ws("", F.slice(low, at + 2, F.lit(WAYS - 1) - inside)).alias("after"),
    )


def _down(levels: list[DataFrame], ends: DataFrame, carry: list[str]) -> DataFrame:
    """Path of every node of levels[0] to the end of its tree and beyond. ends(tree, place, path, *kept): the node that
    levels[-1] holds of each tree, with what lies above it."""
    kept = [c for c in ends.columns if c not in ("tree", "place", "path")]
    above = ends
    for k in range(len(levels) - 2, -1, -1):
        inner = carry if k == 0 else []
        subtrees = _subtrees(levels[k], inner).join(above.withColumnRenamed("place", "above"), ["tree", "above"])
        steps = F.concat(*[
            F.when(_level_nodes(F.col("n_nodes"), i) > 1, F.array(_siblings(i))).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
            for i in range(STEP)
        ])
        nodes = subtrees.select("*", F.posexplode("nodes").alias("at", "node"))
        above = nodes.select(
            "tree", F.col("node.place").alias("place"), *([F.col("node.digest").alias("digest")] if k == 0 else []),
            *[F.col("node")[c].alias(c) for c in inner], F.concat(steps, "path").alias("path"), *kept,
        )
        if k:
            above = written(above, "manifest-paths")
    if len(levels) == 1:
        return levels[0].select("tree", "place", "digest", *carry).join(ends.drop("place"), "tree")
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof: tree, place, digest, row, subroot, root and `path`, per level, leaf upwards, the
    digests of its siblings before and after it."""
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    top = manifest.top[-1].select("tree", "place", no_path.alias("path"))
    tops = _down(manifest.top, top, ["member"])
    ends = tops.select(
        F.col("member").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
    )
    return _down(manifest.levels, written(ends, "manifest-ends"), ["row"])


def path_digest(path: Column) -> Column:
    """Digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))
