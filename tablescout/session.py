"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_fallback_dirs: dict[str, str] = {}


def build_session(master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName("tablescout")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in spark.checkpoint.dir. Only a single local
    process may do without and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    app = spark.sparkContext.applicationId
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _fallback_dirs:
            _fallback_dirs[app] = tempfile.mkdtemp(prefix="tablescout-")
        named = _fallback_dirs[app]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never re-used path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, **options: str):
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of a few MB, whatever their number and length, so that neither a worker nor
    the buffers between hold more. A session that was started with a limit of its own keeps it."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(limit):
        spark.conf.set(limit, str(BATCH_BYTES))
