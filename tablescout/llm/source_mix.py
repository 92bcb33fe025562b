"""Mixing sources to target weights by fitting a word budget exactly.

Every source gets a target; its documents are counted by exact length; whole copies cover what they
can, and the remaining budget is fitted as a subset sum: an even share of every length first, then a
bounded-knapsack dynamic programme over what is left. The counts by length are then turned back into
documents by a seeded order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
KNAPSACK_WORDS = 20_000
HASH_CELLS = 256
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: str) -> Column:
    """Number of stretches without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Adds target to totals(no_source, source, source_size), one row per source.

    Weights repeat along the sources by code point, null last. The budget is `share` of all sizes; a
    source takes at most `most` times its size and the excess goes to the others by weight. Filling up
    the sources in the order of capacity per weight gives the end of that resharing directly: a source
    is full when the level that fills it is reached before the budget is spent. The windows see one
    small row per source, as the caller's weights do."""
    row = F.row_number().over(Window.orderBy("no_source", "source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("_w", F.element_at(cycle, (F.pmod(row - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_level", F.col("_cap") / F.col("_w"))
    lower = Window.orderBy("_level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    rows = rows.withColumn("_budget", F.sum("source_size").over(every) * float(share))
    spent = F.sum("_cap").over(lower) + F.col("_level") * (F.sum("_w").over(every) - F.sum("_w").over(lower))
    rows = rows.withColumn("_is_full", spent <= F.col("_budget"))
    taken = F.coalesce(F.sum(F.when(F.col("_is_full"), F.col("_cap"))).over(every), F.lit(0.0))
    level = (F.col("_budget") - taken) / F.sum(F.when(~F.col("_is_full"), F.col("_w"))).over(every)
    target = F.when(F.col("_is_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return rows.select("no_source", "source", "source_size", target.alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, words: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come nearest to `budget` (the
    smaller sum on ties). Lengths are positive and ascending."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    # Longest first until the programme's table covers what is left.
    for i in range(len(lengths) - 1, -1, -1):
        if left <= words:
            break
        more = min(counts[i] - take[i], (left - words + lengths[i] - 1) // lengths[i], left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    fit = _knapsack([(i, n, counts[i] - take[i]) for i, n in enumerate(lengths)], left)
    for i, more in fit.items():
        take[i] += more
    return take


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """Bounded knapsack on bit sets: bit s of the set is on when the sum s can be reached. Counts are cut
    into powers of two; the sets are kept to walk back from the best sum."""
    if budget <= 0:
        return {}
    limit = 2 * budget  # a sum above the budget may be nearer, but not beyond twice the budget
    mask = (1 << (limit + 1)) - 1
    steps, reached = [], 1
    for i, n, c in items:
        c = min(c, limit // n)
        size = 1
        while c > 0 and not reached >> budget & 1:
            size = min(size, c)
            steps.append((i, n * size, size, reached))
            reached |= (reached << (n * size)) & mask
            c -= size
            size *= 2
    under = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reached >> (budget + 1)
    best = under
    if under < budget and over:
        up = budget + 1 + ((over & -over).bit_length() - 1)
        best = up if up - budget < budget - under else under
    fit: dict[int, int] = {}
    for i, span, size, before in reversed(steps):
        if not (before >> best & 1):  # this sum needs the step
            fit[i] = fit.get(i, 0) + size
            best -= span
    return fit


def _plan(table: pd.DataFrame) -> pd.DataFrame:
    """Whole and extra copies by length for one source."""
    table = table.sort_values("size")
    size, target = int(table["source_size"].iloc[0]), float(table["target"].iloc[0])
    whole = int(target // size)
    extra = fit_counts([int(x) for x in table["size"]], [int(x) for x in table["n"]], round(target - whole * size))
    return table[["no_source", "source", "size"]].assign(whole=whole, extra=extra)


def mix(
    df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42,
    carry: list[str] | None = None, **law,
) -> DataFrame:
    """The columns `carry` (all if None) of every row with size, source_size, target and taken: the words the
    mix takes of it, repeats counted. Columns named like a result are replaced.

    taken is size times a number of copies from 0 to 2. Null and wordless texts have size 0 and take 0; a
    source without words has target 0. Null sources are one source. Which documents of a length get the
    extra copy follows a hash of seed, key and text, so reruns agree; rows equal in both are
    interchangeable.

    Documents meet by (source, size, hash cell), so a hot source, or one length that fills it, is spread
    over HASH_CELLS groups; the programme sees one row per source and length."""
    names = {c: f"_in_{c}" for c in (df.columns if carry is None else carry) if c not in RESULTS}
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        word_count(text).alias("size"), order.alias("_order"),
        F.pmod(F.shiftrightunsigned(order, 40), F.lit(HASH_CELLS)).cast("int").alias("_cell"), F.col(key).alias("_key"),
    )
    name, group = ["no_source", "source"], ["no_source", "source", "size"]
    cells = written(rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n")), "mix-cells")
    lengths = cells.groupBy(*group).agg(F.sum("_n").alias("n"))
    goals = targets(lengths.groupBy(*name).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **law)
    plan = (
        lengths.where("size > 0").join(goals, name).groupBy(*name)
        .applyInPandas(_plan, "no_source boolean, source string, size long, whole long, extra long")
    )
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    share = (
        cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(plan, group, "left").join(goals, name)
        .select(*group, "_cell", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("_whole"),
                (F.coalesce("extra", F.lit(0)) - F.col("_before")).alias("_extra"))
    )
    place = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_order", "_key"))
    copies = F.col("_whole") + F.when(place <= F.col("_extra"), 1).otherwise(0)
    return rows.join(share, [*group, "_cell"]).select(
        *[F.col(n).alias(c) for c, n in names.items()], "size", "source_size", "target",
        (F.col("size") * copies).cast("long").alias("taken"),
    )
