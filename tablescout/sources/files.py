"""File sources and sinks: typed tables, the recursive lake, metadata and JSON lines."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tablescout.functions.answers import INVALID_TABLE_FILE
from tablescout.functions.text import strip
from tablescout.operators.catalog import normal_id, table_name
from tablescout.session import materialize, text_batches

FOOTER_READERS = 16
FOOTER_FILE = 32 << 20
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"  # fixed name of the key under which Spark stores its schema
SUPPORTED = ("csv", "parquet")
MANY_FILES = 10_000

ROW_SCHEMA = "table_id string, row_idx bigint, names array<string>, cells array<string>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, drop_malformed: bool = True) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; types inferred unless given."""
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    )
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_object_store(
    spark: SparkSession, path: str, fmt: str = "parquet", region: str | None = None,
    access_key: str | None = None, secret_key: str | None = None,
) -> DataFrame:
    """The same scans over an object-store address; credentials travel as read options."""
    options = {"fs.s3a.endpoint.region": region, "fs.s3a.access.key": access_key, "fs.s3a.secret.key": secret_key}
    reader = spark.read.options(**{k: v for k, v in options.items() if v})
    if fmt == "csv":
        return reader.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.parquet(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, extension, length) of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length")
    )


def file_outcomes(files: DataFrame) -> DataFrame:
    """Per file: its id, name, whether it is taken, and a reason if not."""
    ok = F.col("extension").isin(*SUPPORTED)
    return files.select(
        "path", "extension", "length", normal_id(F.col("path")).alias("id"), table_name(F.col("path")).alias("table_name"),
        ok.alias("accepted"),
        F.when(~ok, INVALID_TABLE_FILE).alias("reason"),
    )


def lake_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(table_id, row_idx, names, cells) of every CSV below a folder in one job.

    Each file also yields a row -1 without cells, so a table of a header alone is known.

    Records arrive as positional variants, so files need no common schema; a
    file streams through one task because quoted fields may hold line breaks. The first
    record of a file names its columns; a record of another width is malformed and left out."""
    raw = (
        spark.read.option("singleVariantColumn", "record").option("header", False).option("multiLine", True)
        .option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    )
    fields = F.from_json(F.to_json("record"), "map<string,string>")
    in_order = F.transform(
        F.sequence(F.lit(0), F.size("_f") - 1), lambda i: F.try_element_at("_f", F.concat(F.lit("_c"), i.cast("string")))
    )
    records = raw.select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"), fields.alias("_f")
    ).where(F.size("_f") > 0).select("path", "_at", in_order.alias("cells"))
    headers = records.groupBy("path").agg(F.min("_at").alias("_first"), F.min_by("cells", "_at").alias("names"))
    if len(raw.inputFiles()) <= MANY_FILES:  # one header row per file
        headers = F.broadcast(headers)
    return (
        records.join(headers, "path")
        .where(F.size("cells") == F.size("names"))
        .select(
            normal_id(F.col("path")).alias("table_id"), (F.col("_at") - F.col("_first") - 1).alias("row_idx"), "names",
            F.when(F.col("_at") > F.col("_first"), F.col("cells")).alias("cells"),
        )
    )


def _footer_schema(content: bytes) -> str | None:
    """Spark's schema of a Parquet file as JSON; None where only Spark itself can tell."""
    try:
        meta = pq.read_metadata(io.BytesIO(content))
        own = (meta.metadata or {}).get(SPARK_SCHEMA)
        if own:
            return own.decode()
        if any(meta.schema.column(i).physical_type == "INT96" for i in range(len(meta.schema))):
            return None
        return from_arrow_schema(meta.schema.to_arrow_schema(), prefer_timestamp_ntz=True).json()
    except Exception:  # odd or broken files are looked up by Spark, which says what is wrong with them
        return None


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_footer_schema(c.as_py()) for c in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "schema"])


def schema_groups(spark: SparkSession, folder: str) -> list[tuple[StructType, list[str]]]:
    """Parquet files below a folder by schema. Footers of files up to FOOTER_FILE bytes are read in tasks of one job; of
    larger ones, of which there are few for their bytes, and of those whose types only Spark can tell, Spark reads the
    footer alone, several at a time."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    told = materialize(blobs.where(F.col("length") <= FOOTER_FILE).select("path", "content").mapInArrow(_footers, "path string, schema string"), "footers")
    name = F.xxhash64("schema")
    known = {r["h"]: StructType.fromJson(json.loads(r["schema"])) for r in told.where("schema is not null").groupBy(name.alias("h")).agg(F.first("schema").alias("schema")).collect()}
    paths = {r["path"]: known[r["h"]] for r in told.where("schema is not null").select("path", name.alias("h")).collect()}  # names only
    left = [r["path"] for r in blobs.select("path").collect() if r["path"] not in paths]
    with ThreadPoolExecutor(FOOTER_READERS) as pool:
        paths.update(zip(left, pool.map(lambda p: spark.read.parquet(p).schema, left)))
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for path in sorted(paths):
        plain = [(f.name, f.dataType.json()) for f in paths[path]]  # nullability does not matter for reading
        groups.setdefault(json.dumps(plain), (paths[path], []))[1].append(path)
    return list(groups.values())


def lake_parquet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows of every Parquet file below a folder, whatever its size: one typed, splittable scan per
    schema. Values have the text that Spark's cast gives their type, row numbers are the file's own."""
    parts = [spark.createDataFrame([], ROW_SCHEMA)]
    for schema, group in schema_groups(spark, folder):
        names = F.array(*map(F.lit, schema.names)) if schema.names else F.array().cast("array<string>")
        scan = spark.read.schema(schema).parquet(*group)
        cells = F.array(*[F.col(f"`{c}`").cast("string") for c in schema.names]) if schema.names else F.array().cast("array<string>")
        parts.append(scan.select(
            normal_id(F.col("_metadata.file_path")).alias("table_id"), F.col("_metadata.row_index").alias("row_idx"),
            names.alias("names"), cells.alias("cells"),
        ))
        heads = spark.createDataFrame([(p,) for p in group], "path string")
        parts.append(heads.select(
            normal_id(F.regexp_replace("path", "^file:/(?!/)", "file:///")).alias("table_id"), F.lit(-1).cast("long").alias("row_idx"),
            names.alias("names"), F.lit(None).cast("array<string>").alias("cells"),
        ))
    return reduce(lambda x, y: x.unionByName(y), parts)


def lake_rows(spark: SparkSession, folder: str) -> DataFrame:
    return lake_csv_rows(spark, folder).unionByName(lake_parquet_rows(spark, folder))


def cells_of_rows(rows: DataFrame) -> DataFrame:
    return rows.where("row_idx >= 0").select(
        "table_id", "row_idx", F.posexplode(F.arrays_zip("names", "cells")).alias("col_idx", "_c")
    ).select("table_id", "row_idx", "col_idx", F.col("_c.names").alias("col_name"), F.col("_c.cells").alias("value"))


def lake_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_of_rows(lake_rows(spark, folder))


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, value): one row per text file, whole and stripped."""
    return (
        spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("value"))
    )


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, value): one context per record."""
    return (
        spark.read.schema("table_id string, value string").option("header", True).option("multiLine", True)
        .option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
        .withColumn("value", strip(F.col("value")))
    )


def read_metadata_folder(spark: SparkSession, path: str, table_id: str | Column = "") -> DataFrame:
    """(kind, table_id, value) of all text and CSV metadata below a folder; texts belong to `table_id`."""
    owner = table_id if isinstance(table_id, Column) else F.lit(table_id)
    texts = read_texts(spark, path).select(F.lit("txt").alias("kind"), owner.alias("table_id"), "value")
    records = read_metadata_csv(spark, path).select(F.lit("csv").alias("kind"), "table_id", "value")
    return texts.unionByName(records)


TIMESTAMP_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", TIMESTAMP_TEXT).option("timestampNTZFormat", TIMESTAMP_TEXT).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("timestampFormat", TIMESTAMP_TEXT).option("timestampNTZFormat", TIMESTAMP_TEXT).option("ignoreNullFields", False).json(path)


def write_whole_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """One file `name`.txt per name, in one folder per task, so that neither folders nor the driver's commit grow with the
    files; rows that share a name are lines of its file, null is an empty one. Names are numbers or plain words.

    Tasks write through Arrow's file systems and give a file its name when it is whole. Stores that Arrow cannot open
    get a folder `name`=value per file from Spark's writer."""
    spark = df.sparkSession
    named = df.select(F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("name"), F.coalesce(text, F.lit("")).alias("value"))
    try:
        pf.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        df.select(name, F.col(text).alias("value")).write.partitionBy(name).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pf.FileSystem.from_uri(path)
        task = TaskContext.get()
        folder, written = f"{root}/part-{task.partitionId():05d}", 0
        part = f"{folder}/_{uuid.uuid4().hex}"
        current, out = None, None

        def close():
            out.close()
            store.move(part, f"{folder}/{current}.txt")

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != current:
                    if out is None:
                        store.create_dir(folder, recursive=True)
                    else:
                        close()
                    current, out, written = key, store.open_output_stream(part), written + 1
                out.write(value.as_buffer())
                out.write(b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    text_batches(spark)
    named.repartition("name").sortWithinPartitions("name").mapInArrow(run, "files long").agg(F.sum("files")).collect()


def read_whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text): raw file text as one document each."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def write_metrics(results: DataFrame, path: str, dataset: str, stamp: Column | None = None) -> None:
    """One JSON object per result row with its data set and time stamp."""
    stamp = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH-mm-ss")
    body = F.to_json(
        F.struct(F.lit(dataset).alias("dataset"), stamp.alias("timestamp"), F.struct(*results.columns).alias("results"))
    )
    results.select(body.alias("value")).write.text(path)
