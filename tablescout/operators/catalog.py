"""Registration and catalog relations as copy-on-write DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.answers import FILES_PROCESSED
from tablescout.functions.hashing import fingerprint, row_digest
from tablescout.functions.text import strip
from tablescout.operators.scaling import ranked, salted_join, small_side

REGISTERED, SUMMARIZED, DELETED = "REGISTERED", "SUMMARIZED", "DELETED"
COLUMN_NARRATION, ROW_SAMPLE = "COLUMN_NARRATION", "ROW_SAMPLE"

RELATIONS = {
    "table_status": "id string, table_name string, status string, time_created timestamp, creator string, hash string",
    "table_contexts": "id bigint, table_id string, context string",
    "table_summaries": "id bigint, table_id string, summary string, summary_type string",
    "indexes": "id bigint, name string, location string",
    "index_table_mappings": "index_id bigint, table_id string",
    "query_history": "time timestamp, table_id string, query string, response string, querant string",
}


def empty_relations(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in RELATIONS.items()}


def table_fingerprint(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, hash): order-free digest of every table from map-side partial sums."""
    digests = rows.select(table, row_digest([F.col(c) for c in columns]).alias("_d"))
    return digests.groupBy(table).agg(fingerprint(F.col("_d")).alias("hash"))


def split_duplicates(incoming: DataFrame, registered: DataFrame, key: str = "id", accept: bool = False) -> DataFrame:
    """Adds `accepted` and `same_as`: one table per new content, none whose content is registered.

    The winner of a content is a map-side minimum. Contents shared by very many
    tables are salted when the winners are joined back."""
    if accept:
        return incoming.withColumn("accepted", F.lit(True)).withColumn("same_as", F.lit(None).cast(incoming.schema[key].dataType))
    firsts = incoming.groupBy("hash").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    known = registered.groupBy("hash").agg(F.min(key).alias("known"))
    winners = firsts.join(known, "hash", "left")
    joined = salted_join(incoming, winners.drop("n"), winners.select("hash", "n"), ["hash"], [key])
    is_first = F.col("known").isNull() & (F.col("first") == F.col(key))
    return joined.select(
        *incoming.columns, is_first.alias("accepted"), F.when(~is_first, F.coalesce("known", "first")).alias("same_as")
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace rows of the same key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def normal_id(path: Column) -> Column:
    """Forward slashes, and no double quotes inside an identifier."""
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("''"))


def table_name(path: Column) -> Column:
    """File name without its extension."""
    last = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def pending(status: DataFrame, table_id: str | None = None) -> DataFrame:
    return status.where(F.col("id") == table_id) if table_id else status.where(F.col("status") == REGISTERED)


def unsummarised(wanted: DataFrame, status: DataFrame) -> DataFrame:
    done = status.where(F.col("status").isin(SUMMARIZED, DELETED)).select("id")
    return wanted.join(done, "id", "left_anti")


def mark(status: DataFrame, processed: DataFrame, new: str = SUMMARIZED) -> DataFrame:
    ids = processed.select("id").distinct().withColumn("_hit", F.lit(True))
    return status.join(ids, "id", "left").withColumn(
        "status", F.when(F.col("_hit"), new).otherwise(F.col("status"))
    ).drop("_hit")


def payload(text: Column) -> Column:
    return F.to_json(F.struct(strip(text).alias("payload")))


def check_references(metadata: DataFrame, status: DataFrame) -> DataFrame:
    """Metadata with `accepted`, its JSON payload, and a reason where the table is unknown."""
    known = status.select(F.col("id").alias("table_id"), F.lit(True).alias("_known")).distinct()
    joined = metadata.join(known, "table_id", "left")
    ok = F.col("_known").isNotNull()
    return joined.select(
        *metadata.columns, ok.alias("accepted"), F.when(ok, payload(F.col("value"))).alias("context"),
        F.when(~ok, F.concat(F.lit("unknown table "), F.col("table_id"))).alias("reason"),
    )


def assign_ids(rows: DataFrame, last_id: int | Column, order: str, name: str = "id") -> DataFrame:
    """Sequence numbers after `last_id` in the order of an integer key; no single-task sort."""
    start = last_id if isinstance(last_id, Column) else F.lit(last_id)
    return ranked(rows, [], [F.col(order)], "_pos").withColumn(name, (start + 1 + F.col("_pos")).cast("long")).drop("_pos")


def free_names(requests: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """First request per index name not in the registry."""
    first = requests.groupBy("name").agg(F.min(key).alias(key))
    return first.join(small_side(registry.select("name").distinct()), "name", "left_anti")


def map_tables(tables: DataFrame, index_ids: list[int]) -> DataFrame:
    """(index_id, table_id) without repeats: every table under each of the given index parts."""
    each = F.explode(F.array(*[F.lit(i).cast("long") for i in index_ids]))
    return tables.select("table_id").distinct().select(each.alias("index_id"), "table_id")


def batch_report(outcomes: DataFrame, by: str) -> DataFrame:
    """Per batch: files, failures and the response envelope; per-file rows stay rows."""
    counts = outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("file_count"), F.count(F.when(~F.col("accepted"), 1)).alias("failed")
    )
    return counts.withColumn("response", envelope(
        F.lit("SUCCESS"),
        F.replace(F.replace(F.lit(FILES_PROCESSED), F.lit("{n}"), F.col("file_count").cast("string")), F.lit("{path}"), F.col(by)),
        F.struct("file_count"),
    ))


def envelope(status: Column, message: Column, data: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), message.alias("message"), data.alias("data")))
