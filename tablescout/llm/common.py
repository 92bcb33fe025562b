"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.session import shared_folder, text_batches  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once below the cluster's shared folder and reads it back: cuts the lineage and
    leaves a copy that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8_bytes(text: str) -> Column:
    """UTF-8 length of a text column, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
