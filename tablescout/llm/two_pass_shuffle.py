"""Global shuffle into shards by the two-pass external method, in DataFrame functions only.

Pass one scatters the rows over buckets by a seeded hash; a bucket holds about `bucket_bytes`. Pass two
brings one bucket at a time into memory, puts it in a fixed order, permutes it with Fisher-Yates
(Spark's `shuffle` function, seeded) and hands its rows on. The buckets one after the other are the
shuffled order; shards are equal cuts of it, so their row counts differ by one at most."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescout.session import shared_folder

BUCKET_BYTES = 8 << 20
ROW_BYTES = 64
_BLOCK = 4096


def row_hash(df: DataFrame, seed: int) -> Column:
    """Seeded hash of a whole row."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in df.columns])


def bucket_offsets(sizes: DataFrame) -> DataFrame:
    """Rows before each bucket. sizes(bucket, n); two levels, so no window sees more than the buckets of
    one block or the blocks."""
    blocked = sizes.withColumn("_block", F.floor(F.col("bucket") / _BLOCK))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_block").agg(F.sum("n").alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(blocks, "_block").select(
        "bucket", (F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset")
    )


def two_pass_shuffle(
    df: DataFrame, shards: int, size: Column, seed: int = 42, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows of `df` with shard (int, from 0) and slot (long, gapless from 0 in its shard).

    `size` estimates a row's bytes. A row's bucket depends on the seed and the row alone. Rows that
    repeat in every column share a bucket and are shuffled as rows of their own. An empty table gives
    an empty result; columns named shard or slot are replaced. One task holds one bucket at a time."""
    rows = df.drop("shard", "slot")
    columns = rows.columns
    bytes_total, total = rows.agg(F.sum(size + ROW_BYTES), F.count(F.lit(1))).first()
    buckets = max(1, -(-int(bytes_total or 0) // bucket_bytes))
    at = rows.withColumn("_hash", row_hash(rows, seed)).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    sizes = at.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # A fixed partition count and a fixed order inside make the permutation the same in every run and
    # after a lost task: `shuffle` draws from its seed and the partition's number.
    tasks = min(buckets, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    record = F.struct("_hash", *[F.col(f"`{c}`") for c in columns])
    permuted = (
        at.repartition(tasks, "_bucket").groupBy("_bucket").agg(F.sort_array(F.collect_list(record)).alias("_rows"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", F.shuffle("_rows", seed).alias("_rows"))
    )
    placed = (
        permuted.join(bucket_offsets(sizes).withColumnRenamed("bucket", "_bucket"), "_bucket")
        .select("offset", F.posexplode("_rows").alias("_at", "_row"))
        .withColumn("_place", F.col("offset") + F.col("_at"))
    )
    least, longer = divmod(total, shards)
    edge = longer * (least + 1)
    if least == 0:
        shard, slot = F.col("_place"), F.lit(0)
    else:
        early = F.col("_place") < edge
        shard = F.when(early, F.floor(F.col("_place") / (least + 1))).otherwise(
            longer + F.floor((F.col("_place") - edge) / least)
        )
        slot = F.when(early, F.col("_place") % (least + 1)).otherwise((F.col("_place") - edge) % least)
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in columns], shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str | None = None) -> str:
    """Writes the shuffled rows as Parquet, one folder per shard. A bucket meets two shards at most
    unless shards are smaller than buckets, so files stay large. Returns the folder."""
    spark: SparkSession = shuffled.sparkSession
    path = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shuffled.write.partitionBy("shard").parquet(path)
    return path
