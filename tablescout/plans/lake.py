"""The driver's relational tables seen as a lake of small tables, with SQL of the same shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablescout.operators.documents import schema_of
from tablescout.plans.registry import table
from tablescout.sources.nested import typed_cells

# table -> (row key, columns in order)
LAKE = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": (
        "o_orderkey",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ),
}


def plain(column: str) -> str:
    """Column name without its table prefix, so that tables share names."""
    return column.split("_", 1)[1]


def lake_cells(spark, sf):
    parts = []
    for name, (key, columns) in LAKE.items():
        df = table(spark, sf, name, *columns, by=key if name == "orders" else None)  # the one large table
        named = df.select(F.col(key).cast("long").alias("_row"), *[F.col(c).alias(plain(c)) for c in columns])
        parts.append(typed_cells(named, F.lit(name), "_row"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def lake_rows(spark, sf):
    """(table_id, row_idx, names, cells) of all tables; values as lake_cells has them."""
    parts = []
    for name, (key, columns) in LAKE.items():
        df = table(spark, sf, name, *columns, by=key if name == "orders" else None)
        parts.append(df.select(
            F.lit(name).alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.array(*[F.lit(plain(c)) for c in columns]).alias("names"),
            F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def lake_columns(spark, sf):
    """Headers of all tables from the schemas of their files; no row is read."""
    parts = [schema_of(table(spark, sf, name, *columns).toDF(*map(plain, columns)), name) for name, (_, columns) in LAKE.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


CELLS_SQL = "cells as (" + " union all ".join(
    f"select '{t}' as table_id, {key}::bigint as row_idx, {i}::int as col_idx, '{plain(c)}' as col_name, {c}::varchar as value from {t}"
    for t, (key, columns) in LAKE.items()
    for i, c in enumerate(columns)
) + ")"

COLUMNS_SQL = f"{CELLS_SQL}, cols as (select distinct table_id, col_idx, col_name from cells)"
