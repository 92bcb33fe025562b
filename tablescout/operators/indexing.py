"""Stored hybrid indexes of immutable segments: append, delete and merge without touching what is there.

A segment holds documents, full-text blocks with their term counts, and vectors filed under pivots. The index is the
newest complete version of a small list of segments and tombstones; a call that fails leaves the list as it was.
Statistics are sums over segments minus tombstones, looked up for the asked terms only, so answers equal those of a
new build."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.answers import INDEX_UNKNOWN
from tablescout.operators import textindex as X
from tablescout.operators import vectors as V
from tablescout.operators.scaling import small_side
from tablescout.operators.store import Store
from tablescout.operators.topk import merged

PARTS = "part string, kind string"
SEGMENT, TOMBSTONES = "segment", "tombstones"


def write_fulltext(corpus: DataFrame, path: str, stem: bool = True) -> None:
    """Blocks, document frequencies and totals of one segment; texts are analysed once."""
    spark = corpus.sparkSession
    X.text_blocks(X.analyze(corpus, stem=stem)).write.options(**X.BLOCK_FILES).parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    X.block_terms(blocks).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    X.block_totals(blocks).write.parquet(f"{path}/totals")


def write_vectors(corpus: DataFrame, path: str, embed: Callable | None = None, dim: int = 64) -> None:
    """Unit vectors filed under the segment's own pivots, in the order of their lists; pivots carry the list sizes."""
    spark = corpus.sparkSession
    embedded = V.embed_column(corpus.select("doc_id", "text"), "text", embed, dim)
    embedded.select("doc_id", V.unit("vector").alias("vector")).write.parquet(f"{path}/embedded")
    pivots, filed = V.pivot_lists(spark.read.parquet(f"{path}/embedded"))
    filed.write.parquet(f"{path}/filed")
    filed = spark.read.parquet(f"{path}/filed")
    filed.repartitionByRange("list", "doc_id").sortWithinPartitions("list", "doc_id").write.parquet(f"{path}/vectors")
    sizes = filed.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    pivots.join(sizes, "list", "left").write.parquet(f"{path}/pivots")


def _manifest(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, kind) of all parts of the newest version: one row per append or deletion."""
    return sorted((r["part"], r["kind"]) for r in Store(spark, path).read("manifest", PARTS).collect())


def _publish(spark: SparkSession, path: str, parts: list[tuple[str, str]]) -> None:
    Store(spark, path).write("manifest", spark.createDataFrame(parts, PARTS).coalesce(1))


def write_segment(corpus: DataFrame, path: str, embed=None, stem: bool = True, dim: int = 64) -> str:
    """A new segment below `path`, not yet part of the index. Returns its folder."""
    part = f"{path}/segments/{uuid.uuid4().hex}"
    corpus.write.parquet(f"{part}/documents")
    stored = corpus.sparkSession.read.parquet(f"{part}/documents")
    write_vectors(stored, part, embed, dim)
    write_fulltext(stored, part, stem)
    return part


def build_index(corpus: DataFrame, path: str, embed=None, stem: bool = True, dim: int = 64) -> None:
    """corpus(doc_id, table_id, kind, text) as an index of one segment. Nothing is registered here."""
    _publish(corpus.sparkSession, path, [(write_segment(corpus, path, embed, stem, dim), SEGMENT)])


def append_index(corpus: DataFrame, path: str, embed=None, stem: bool = True, dim: int = 64) -> None:
    """Adds those documents whose id the index does not have: one new segment, and a new list of segments."""
    spark = corpus.sparkSession
    old = stored(spark, path, "documents")
    new = corpus.select(*old.columns).join(old.select("doc_id"), "doc_id", "left_anti").select(*old.columns)
    _publish(spark, path, [*_manifest(spark, path), (write_segment(new, path, embed, stem, dim), SEGMENT)])


def delete_documents(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Deletes the documents ids(doc_id): their places in the blocks and their share of the statistics become a tombstone.
    Ids that the index does not have are passed over."""
    live = stored(spark, path, "documents").select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    part = f"{path}/tombstones/{uuid.uuid4().hex}"
    live.write.parquet(f"{part}/ids")
    gone = spark.read.parquet(f"{part}/ids")
    blocks = _read(spark, _manifest(spark, path), SEGMENT, "blocks")
    places = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).join(small_side(gone), "doc_id", "left_semi")
    places.groupBy("block").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("places")).write.parquet(f"{part}/places")
    hit = X.with_gone(blocks, spark.read.schema(FIXED["places"]).parquet(f"{part}/places"))
    X.lost_terms(hit).groupBy("term").agg((-F.sum("df")).alias("df")).write.parquet(f"{part}/terms")
    lengths = F.aggregate("gone", F.lit(0).cast("long"), lambda s, p: s + F.col("lengths")[p])
    hit.agg(
        (-F.coalesce(F.sum(F.size("gone")), F.lit(0))).alias("n"), (-F.coalesce(F.sum(lengths), F.lit(0))).alias("len")
    ).write.parquet(f"{part}/totals")
    _publish(spark, path, [*_manifest(spark, path), (part, TOMBSTONES)])


def merge_index(spark: SparkSession, path: str, embed=None, stem: bool = True, dim: int = 64) -> None:
    """One segment of all live documents; earlier versions stay readable until their folders are dropped."""
    _publish(spark, path, [(write_segment(stored(spark, path, "documents"), path, embed, stem, dim), SEGMENT)])


#: Schemas of the parts whose columns do not depend on the corpus.
FIXED = {"terms": "term string, df long", "totals": "n long, len long", "places": "block string, places array<int>"}


def _read(spark: SparkSession, parts: list[tuple[str, str]], kind: str, name: str) -> DataFrame | None:
    folders = [f"{p}/{name}" for p, k in parts if k == kind]
    reader = spark.read.schema(FIXED[name]) if name in FIXED else spark.read
    return reader.parquet(*folders) if folders else None


def _live(spark: SparkSession, parts: list[tuple[str, str]], df: DataFrame) -> DataFrame:
    gone = _read(spark, parts, TOMBSTONES, "ids")
    return df if gone is None else df.join(small_side(gone), "doc_id", "left_anti")


def stored(spark: SparkSession, path: str, part: str) -> DataFrame:
    """documents or vectors of all segments, without deleted ones."""
    parts = _manifest(spark, path)
    df = _read(spark, parts, SEGMENT, part)
    columns = ["doc_id", "vector"] if part == "vectors" else df.columns
    return _live(spark, parts, df.select(columns)).select(columns)


def text_source(spark: SparkSession, path: str) -> X.TextSource:
    """The full-text part of a stored index."""
    parts = _manifest(spark, path)
    both = lambda name: reduce(DataFrame.unionByName, [d for k in (SEGMENT, TOMBSTONES) if (d := _read(spark, parts, k, name)) is not None])
    dead = _read(spark, parts, TOMBSTONES, "places")
    if dead is not None:
        dead = dead.groupBy("block").agg(F.flatten(F.collect_list("places")).alias("places"))
    return X.TextSource(_read(spark, parts, SEGMENT, "blocks"), both("terms"), both("totals"), dead)


def near_documents(spark: SparkSession, path: str, queries: DataFrame, k: int, share: float | None = None) -> DataFrame:
    """Vector answers of a stored index: exact, or from the lists of every segment when `share` is given."""
    if share is None:
        return V.vector_topk(queries, stored(spark, path, "vectors"), k)
    parts, found = _manifest(spark, path), []
    for part in (p for p, k in parts if k == SEGMENT):
        filed = _live(spark, parts, spark.read.parquet(f"{part}/vectors"))
        found.append(V.lists_topk(queries, filed, spark.read.parquet(f"{part}/pivots"), k, share).drop("rank"))
    return merged(found, found[0].schema, spark, k)


def unknown_indexes(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, message) of requested indexes nobody registered."""
    return requests.select("name").distinct().join(registry.select("name").distinct(), "name", "left_anti").withColumn(
        "message", F.replace(F.lit(INDEX_UNKNOWN), F.lit("{name}"), F.col("name"))
    )


def open_or_build(spark: SparkSession, path: str, corpus: Callable[[], DataFrame], embed=None, stem: bool = True,
                  reindex: bool = False) -> None:
    """Build unless a complete index is there; `reindex` replaces it. The list of segments is written last."""
    store = Store(spark, path.rsplit("/", 1)[0])
    if store.exists(path):
        if Store(spark, path).has("manifest") and not reindex:
            return
        store.drop(path)
    build_index(corpus(), path, embed, stem)
