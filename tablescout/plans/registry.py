"""Named queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescout.operators.scaling import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def cast_oracle(name: str, types: dict[str, str]) -> None:
    casts = ", ".join(f"{c}::{t} as {c}" for c, t in types.items())
    ORACLES[name] = f"select * replace ({casts}) from ({ORACLES[name]}\n) casted"


_frames: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str, by: str | None = None) -> DataFrame:
    """A driver table with only the asked columns, spread over the cores if it is one split.

    The file listing and schema of a table are looked up once per application; no data is kept."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _frames:
        _frames[key] = spark.read.parquet(key[1])
    df = _frames[key]
    if columns:
        df = df.select(*columns)
    return spread(df, by) if by else df
