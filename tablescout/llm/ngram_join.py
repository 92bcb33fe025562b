"""Jaccard join on word shingles with count-vector R-trees.

Shingles are hashed into GROUPS groups; a document's counts by group are its point. The sum of
coordinate minima of two points bounds their overlap from above, and the same sum against the upper
corner of a rectangle bounds it for all points inside, which is what an R-tree over points needs.

Which documents have to meet in a tree is decided by shared shingles: documents at or above the
threshold share one of the first (1 - t) n + 1 shingles of any common order. The order puts shingles
that recur a lot last, so passages that many documents share seldom name a tree. Then:

1. Equal sets are one node from the start; the nodes of a repeated id are linked.
2. In every tree's bucket the nodes are compared with its first and last node. Links join components.
3. Buckets of more than three nodes that still hold several components go through R-trees: nodes
   outside the bucket's largest component search the members of other components. Pairs inside one
   component need no check, so groups of copies never turn into all their pairs. A first round tries
   the few best bounded members of each component, a second all that are still apart.

Every candidate is bounded by points first and verified on whole shingle sets. No link is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import text_batches, written
from tablescout.llm.shingles import set_key, shingle_set

GROUPS = 256
LONG_GROUPS = 1024
LONG_SET = 1024
FIRST_TRIES = 3
COMMON_LIMIT = 100_000
COUNT_STEP = 2_000_000
CELL_NODES = 1_024
DESCRIBE_STEP = 512
HELD_COMMON = 1_000_000
FAN_OUT = 16
FILTER_BITS = 1 << 23


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


# ---- points, keys and prefixes --------------------------------------------------------------------


def group_counts(shingles: np.ndarray) -> bytes:
    """The point of a set: its shingles by group, the group being the top bits of the hash. Sets beyond
    LONG_SET have LONG_GROUPS groups, which fold to GROUPS; counts take one byte if all fit. The first
    byte says which."""
    groups = GROUPS if len(shingles) <= LONG_SET else LONG_GROUPS
    counts = np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    wide = counts.max(initial=0) > 255
    return bytes([2 * (groups == LONG_GROUPS) + wide]) + counts.astype(np.uint32 if wide else np.uint8).tobytes()


def _point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.uint32 if raw[0] & 1 else np.uint8)


def _folded(point: np.ndarray) -> np.ndarray:
    return point.astype(np.int64) if len(point) == GROUPS else point.reshape(GROUPS, -1).sum(axis=1, dtype=np.int64)


def _describe(words: int):
    """Per document: id, text key, set size, set key, point. At the end of a partition one row without `point` for
    the shingles that recur in it, so that the order of shingles costs no pass of its own."""
    names = ["doc_id", "text_key", "n_shingles", "node", "point", "common", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, size, docs = [], 0, 0

        def count() -> None:
            nonlocal common, held, size, docs
            if held:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= max(3, docs // 2000)
                common = _most(*common, values[often], n[often], HELD_COMMON)
            held, size, docs = [], 0, 0

        for whole in batches:
            for at in range(0, whole.num_rows, DESCRIBE_STEP):
                batch = whole.slice(at, DESCRIBE_STEP)
                sets = [shingle_set(t.as_py(), words) for t in _column(batch, "text")]
                for s in sets:
                    held.append(s)
                    size, docs = size + len(s), docs + 1
                    if size >= COUNT_STEP:
                        count()
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, "doc_id"), _column(batch, "text_key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s) for s in sets], pa.int64()),
                     _binary([group_counts(s) for s in sets]),
                     pa.nulls(len(sets), pa.list_(pa.int64())), pa.nulls(len(sets), pa.list_(pa.int64()))],
                    names,
                )
        count()
        common = _most(*common, common[0][:0], common[1][:0], COMMON_LIMIT)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()),
             pa.array([common[0].view(np.int64)], pa.list_(pa.int64())), pa.array([common[1]], pa.list_(pa.int64()))],
            names,
        )

    return run


def _most(values: np.ndarray, times: np.ndarray, more: np.ndarray, more_times: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Both lists of shingles added up; of more than `limit` those that recur most stay, ties to the smaller."""
    found, at = np.unique(np.concatenate([values, more]), return_inverse=True)
    n = np.bincount(at, np.concatenate([times, more_times]), len(found)).astype(np.int64)
    if len(found) > limit:
        keep = np.sort(np.lexsort((found, -n))[:limit])
        found, n = found[keep], n[keep]
    return found, n


_DESCRIBED = "doc_id long, text_key long, n_shingles long, node long, point binary, common array<long>, times array<long>"


def _most_common(described: DataFrame) -> np.ndarray:
    """Up to COMMON_LIMIT shingles that recur most, sorted. The list only orders shingles: any list gives
    the same links."""
    pairs = described.where("common is not null").select(F.explode(F.arrays_zip("common", "times")).alias("p"))
    top = pairs.groupBy(F.col("p.common").alias("h")).agg(F.sum("p.times").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON_LIMIT)
    found = top.select("h").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(found)


def prefix(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles in the order (common last, hash)."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    if not len(common):
        return shingles[:size]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    late = common[at] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:size]


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, heads = [], []
                for text in _column(batch, "text")[at : at + 256]:
                    s = shingle_set(text.as_py(), words)
                    key = set_key(s)
                    if len(s) and key not in seen:  # copies in one partition give their rows once
                        seen.add(key)
                        heads.append(prefix(s, common, percent))
                        names.append(np.full(len(heads[-1]), key, np.int64))
                if heads:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(names))], ["h", "node"]
                    )

    return run


# ---- bounds and verification ----------------------------------------------------------------------


def needed(n_a, n_b, percent: int):
    """Least overlap of linked sets: 100 i >= percent (a + b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _points(column: pa.Array) -> np.ndarray:
    """Points of equal width as one matrix."""
    return np.array([_folded(_point(raw)) for raw in column.to_pylist()], np.int64).reshape(-1, GROUPS)


def point_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles two sets can share; folds the wider point."""
    if len(a) != len(b):
        a, b = _folded(a), _folded(b)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def _bounded(percent: int):
    """Keeps the pairs whose points allow the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(_column(batch, "point_a").to_pylist(), _column(batch, "point_b").to_pylist()):
                a, b = _point(a), _point(b)
                ok.append(point_bound(a, b) >= needed(int(a.sum(dtype=np.int64)), int(b.sum(dtype=np.int64)), percent))
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_column(batch, "set_a"), _column(batch, "set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _slot(keys: np.ndarray) -> np.ndarray:
    """Bit of a text in the fixed-size filter."""
    return (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(41)).astype(np.int64)


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[_slot(batch.column(0).to_numpy())] = True
    yield pa.RecordBatch.from_arrays([_binary([np.packbits(bits).tobytes()])], ["bits"])


def _sets(words: int, shared):
    """Sets of the texts whose key is in the filter, copies in one partition once; a false hit is dropped
    by the join behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool), set()
        for batch in batches:
            keys = _column(batch, "text_key").to_numpy()
            hit = bits[_slot(keys)]
            for i in np.flatnonzero(hit):
                hit[i] = keys[i] not in seen
                seen.add(keys[i])
            batch = batch.filter(pa.array(hit))
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_set(t.as_py(), words) for t in _column(batch, "text")[at : at + 64]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.int64()), _binary([s.tobytes() for s in sets])], ["node", "shingles"]
                )

    return run


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) of nodes that are linked. Pairs are bounded by points; only sets of nodes in surviving
    pairs are computed again from their texts and moved. Nodes with many pairs are hot keys of plain
    joins, whose partitions Spark splits."""
    point = lambda side: nodes.select(F.col("node").alias(side), F.col("point").alias(f"point_{side}"))
    near = written(
        pairs.join(point("a"), "a").join(point("b"), "b").select("a", "b", "point_a", "point_b").mapInArrow(_bounded(percent), "a long, b long"),
        f"{name}-near",
    )
    asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holders = nodes.select("node", "holder").join(asked, "node", "left_semi")
    parts = holders.select("holder").coalesce(16).mapInArrow(_filter_bits, "bits binary").collect()  # 1 MB each
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts:
        bits |= np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    sets = written(
        docs.mapInArrow(_sets(words, shared), "node long, shingles binary")
        .join(asked, "node", "left_semi").dropDuplicates(["node"]), f"{name}-sets",
    )
    one = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    both = near.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b")
    return written(both.mapInArrow(_verified(percent), "a long, b long"), f"{name}-links")


# ---- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b); root is the smallest node reachable. Labels spread along
    edges and jump to their own label's label; each round is a written table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        spread = labels.join(told, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        ends = spread.select(F.col("node").alias("root"), F.col("root").alias("end"))
        moved = written(spread.join(ends, "root").select("node", "was", F.least("root", "end").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("was <> root").limit(1).count() == 0:
            return labels


# ---- R-trees --------------------------------------------------------------------------------------


class RTree:
    """Packed tree over points. Rows are sorted by component, size and one projection of the point, so that
    rectangles of copies are small and a branch of one component can be left out whole."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.order = np.lexsort([points @ np.arange(points.shape[1]), sizes, parts])
        high, low_n, high_n = points[self.order], sizes[self.order], sizes[self.order]
        part = parts[self.order].copy()
        self.levels = [(high, low_n, high_n, part, np.ones(len(part), bool))]
        while len(self.levels[-1][1]) > FAN_OUT:
            high, low_n, high_n, part, one = self.levels[-1]
            cut = np.arange(0, len(low_n), FAN_OUT)
            same = (np.minimum.reduceat(part, cut) == np.maximum.reduceat(part, cut)) & np.logical_and.reduceat(one, cut)
            self.levels.append((np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low_n, cut),
                                np.maximum.reduceat(high_n, cut), part[cut], same))

    def search(self, point: np.ndarray, size: int, part: int, percent: int) -> np.ndarray:
        """Rows of other components whose bound allows a link."""
        open_rows = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n, own, one = (x[open_rows] for x in self.levels[depth])
            ok = ~(one & (own == part)) & (100 * high_n >= percent * size) & (percent * low_n <= 100 * size)
            ok &= np.minimum(high, point).sum(axis=1) >= needed(size, low_n, percent)
            open_rows = open_rows[ok]
            if depth:
                below = (open_rows[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                open_rows = below[below < len(self.levels[depth - 1][1])]
        return self.order[open_rows]


def _tree_pairs(percent: int, tries: int | None):
    """Candidate pairs of sorted cells: rows with `asks` search the tree over the cell's members. With
    `tries` only the best bounded few of each component are named."""

    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        asks = rows["asks"].to_numpy().astype(bool)
        nodes, parts = rows["node"].to_numpy(), rows["root"].to_numpy()
        points = _points(rows["point"])
        sizes = points.sum(axis=1)
        member = np.flatnonzero(~asks)
        tree = RTree(points[member], sizes[member], parts[member])
        a, b = [], []
        for i in np.flatnonzero(asks):
            hits = member[tree.search(points[i], int(sizes[i]), int(parts[i]), percent)]
            if tries and len(hits):
                bound = np.minimum(points[hits], points[i]).sum(axis=1)
                hits = hits[np.lexsort((nodes[hits], -bound, parts[hits]))]
                first = np.flatnonzero(np.append(True, parts[hits][1:] != parts[hits][:-1]))
                place = np.arange(len(hits)) - np.repeat(first, np.diff(np.append(first, len(hits))))
                hits = hits[place < tries]
            a.append(np.full(len(hits), nodes[i]))
            b.append(nodes[hits])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([_column(batch, c).to_numpy() for c in ("h", "row_cell", "ask_cell")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for start, end in zip(cuts, cuts[1:]):
                if key is not None and tuple(keys[start]) != key:
                    if (out := cell(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held and (out := cell(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _tree_candidates(
    rows: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, tries: int | None = None
) -> DataFrame:
    """Pairs of different components for buckets of more than three nodes.

    A bucket with more than CELL_NODES nodes is cut into cells, members one way and asking nodes the other;
    only nodes outside its largest component ask, so a bucket that is one group of copies and a few
    others costs its size and not its square."""
    root = F.coalesce("root", F.col("node"))
    marked = rows.join(labels, "node", "left").withColumn("root", root)
    parts = marked.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("h").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("big"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1 and all > 3").select(
        "h", F.col("big.root").alias("big"), F.ceil(F.col("all") / CELL_NODES).cast("int").alias("row_cells"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("big.n")) / CELL_NODES)).cast("int").alias("ask_cells"),
    )
    open_rows = written(marked.join(buckets, "h"), "tree-rows")
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = open_rows.select(
        "h", "node", "root", F.lit(False).alias("asks"), place(1, "row_cells").alias("row_cell"), span("ask_cells").alias("ask_cell"))
    asking = open_rows.where("root <> big").select(
        "h", "node", "root", F.lit(True).alias("asks"), span("row_cells").alias("row_cell"), place(2, "ask_cells").alias("ask_cell"))
    cells = members.unionByName(asking).join(nodes.select("node", "point"), "node")
    keys = ["h", "row_cell", "ask_cell"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tree_pairs(percent, tries), "a long, b long").distinct()


def _repeated_ids(known: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of ids that have several texts."""
    held = known.where("doc_id is not null and n_shingles > 0").select("doc_id", "node")
    several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    return held.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


# ---- the operator ---------------------------------------------------------------------------------


def near_groups(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two rows link when 100 |A and B| >= percent |A or B| for their sets of `words`-word shingles of the
    whole text (all words as one shingle if there are fewer). component_id is the smallest id reachable
    over links, itself included. Null, empty and wordless texts have empty sets and are groups of their
    own. Rows that repeat an id are one node of the graph, also with several texts; a row without an id
    links like any other, and its component_id is null if no id is reachable."""
    return text_groups(df, words, percent, key, text).select("doc_id", "n_shingles", "component_id")


def text_groups(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """near_groups with text_key (xxhash64 of the text) and root, which names a row's component also where
    no row of it has an id; root is null for empty sets."""
    text_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    described = written(docs.mapInArrow(_describe(words), _DESCRIBED), "shingle-sets")
    known = described.where("point is not null").select("doc_id", "text_key", "n_shingles", "node", "point")
    nodes = written(
        known.where("n_shingles > 0").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("holder"), F.first("point").alias("point")), "nodes",
    )
    common = docs.sparkSession.sparkContext.broadcast(_most_common(described))
    rows = written(docs.mapInArrow(_prefixes(words, percent, common), "h long, node long"), "prefixes")
    again = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    met = written(rows.join(again, "h").distinct(), "buckets")  # most shingles occur once and go here
    ends = met.groupBy("h").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    shared = written(met.join(ends, "h"), "bucket-ends")
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    stars = (
        shared.select(*ordered("first", "node")).union(shared.select(*ordered("last", "node"))).where("a <> b").distinct()
    )
    links = _links(stars, docs, nodes, words, percent, "star").union(_repeated_ids(known))
    labels = components(links)
    members = shared.select("h", "node")
    for tries in (FIRST_TRIES, None):  # the few best of each component first, then all that are still apart
        trees = _tree_candidates(members, nodes, labels, percent, tries)
        links = links.union(_links(trees.join(links, ["a", "b"], "left_anti"), docs, nodes, words, percent, "tree"))
        labels = components(links)
    named = nodes.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("root", F.col("node")))
    linked = named.join(labels.select("node"), "node", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("least"))
    groups = linked.join(smallest, "root").select("node", "root", "least").unionByName(
        named.join(labels.select("node"), "node", "left_anti").select("node", "root", F.col("rep").alias("least"))
    )
    full = known.where("n_shingles > 0").join(groups, "node").select("doc_id", "text_key", "n_shingles", F.col("least").alias("component_id"), "root")
    empty = known.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles")
    # An empty text of an id that also has another text belongs to that id's component.
    its = full.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("its"))
    return full.unionByName(
        empty.join(its, "doc_id", "left")
        .select("doc_id", "text_key", "n_shingles", F.coalesce("its", "doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    )
