"""Size checks, hot-key salting and distributed numbering shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.session import materialize

BROADCAST_ROWS = 100_000
RANK_ROWS = 500_000
HOT_ROWS = 100_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join strategy to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the scan has fewer splits than the cluster has cores.

    Files that already give every core work pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Keys with more rows than one task should get, and into how many parts of at most HOT_ROWS they are cut."""
    return counts.where(F.col(n) > HOT_ROWS).select(*keys, F.ceil(F.col(n) / F.lit(float(HOT_ROWS))).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame, small: DataFrame, counts: DataFrame, keys: list[str], spread_by: list[str]
) -> DataFrame:
    """Inner equi-join where a few keys may hold most of `big`.

    The hot keys are broadcast when their count allows it; their rows in `big` are
    spread over salts and only their rows in `small` are replicated."""
    hot = small_side(hot_keys(counts, keys))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    )
    right = (
        small.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"]).drop("_salt")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark prunes each partition to k rows per group before the
    shuffle (WindowGroupLimit), so a hot group never reaches one task whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ordinal(
    df: DataFrame,
    name: str,
    group: list[str],
    key: str,
    coarse: list[tuple[str, bool]] | None = None,
    chunk: int = 65_536,
) -> DataFrame:
    """0-based position of every row inside its group, ordered by `coarse` columns
    (name, ascending) and then the unique integer `key`.

    A plain window would sort a hot group in one task. Here the key range is cut
    into chunks, chunk sizes are prefix-summed (small aggregate) and only rows of
    one chunk meet in a task."""
    coarse = coarse or []
    cells = [c for c, _ in coarse] + ["_chunk"]
    cut = df.withColumn("_chunk", F.floor(F.col(key) / F.lit(chunk)).cast("long"))
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in coarse] + [F.col("_chunk").asc()]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, *cells)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, *cells).orderBy(key)
    return (
        cut.join(offsets, [*group, *cells])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_offset", "_chunk")
    )


def ranked(
    df: DataFrame, group: list[str], order: list[Column], name: str = "rank", total: int | None = None,
    start: str | None = None, size: str | None = None,
) -> DataFrame:
    """0-based place of every row inside its group by `order`; null is a group of its own and sorts first.

    Rows are sorted once by range partitions of (group, order), so a hot group is spread over many of them.
    A row's place is its place in its partition plus the rows of earlier partitions; the driver sums one number per
    partition and nothing else. Rows equal in group and order get their places in any order. Optional columns:
    `start`, rows before the group among all rows (an order-preserving number of the group), and `size`, its rows."""
    spark = df.sparkSession
    total = df.count() if total is None else total
    parts = max(spark.sparkContext.defaultParallelism, -(-total // RANK_ROWS))
    keys = [F.col(g) for g in group] + list(order)
    at = materialize(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in at.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    if not group:
        extra = [F.lit(v).cast("long").alias(n) for v, n in ((0, start), (before, size)) if n]
        return at.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias(name), *extra)
    whole = Window.partitionBy(*group)
    cells = (
        at.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).join(offsets, "_part")
        .select(
            F.col("_part").alias("_cell"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before",
            F.min(F.col("_before") + F.col("_first")).over(whole).alias("_start"), F.sum("_n").over(whole).alias("_size"),
        )
    )
    same = F.col("_part") == F.col("_cell")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    extra = [F.col(c).alias(n) for c, n in (("_start", start), ("_size", size)) if n]
    return at.join(small_side(cells), same).select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_start")).alias(name), *extra
    )
