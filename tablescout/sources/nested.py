"""Nested table documents (one JSON object per table chunk) and the cell relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_DOCUMENT = 10_000

NESTED_SCHEMA = (
    "tableId string, documentTitle string, chunk bigint, firstRow bigint, "
    "columns array<struct<text:string>>, rows array<struct<cells:array<struct<text:string>>>>"
)


def typed_cells(df: DataFrame, table_id: Column, row: str) -> DataFrame:
    """(table_id, row_idx, col_idx, col_name, value) of a typed table; a narrow step, no shuffle."""
    columns = [c for c in df.columns if c != row]
    packed = F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])
    return df.select(
        table_id.alias("table_id"), F.col(row).cast("long").alias("row_idx"), F.posexplode(packed).alias("col_idx", "c")
    ).select("table_id", "row_idx", "col_idx", "c.col_name", "c.value")


def read_nested(spark, path: str) -> DataFrame:
    return spark.read.schema(NESTED_SCHEMA).json(path)


def cells_of_nested(nested: DataFrame) -> DataFrame:
    rows = nested.select(
        F.col("tableId").alias("table_id"), F.coalesce("firstRow", F.lit(0)).alias("_first"), "columns",
        F.posexplode("rows").alias("_r", "_row"),
    )
    cells = rows.select(
        "table_id", (F.col("_first") + F.col("_r")).alias("row_idx"), "columns",
        F.posexplode("_row.cells").alias("col_idx", "_cell"),
    )
    return cells.select(
        "table_id", "row_idx", "col_idx",
        F.get("columns", F.col("col_idx"))["text"].alias("col_name"), F.col("_cell.text").alias("value"),
    )


def nest_rows(rows: DataFrame, titles: DataFrame | None = None, rows_per_document: int = ROWS_PER_DOCUMENT) -> DataFrame:
    """Nested documents from rows(table_id, row_idx, names, cells), which are grouped once and never opened into cells. A
    table longer than `rows_per_document` becomes several documents with consecutive `firstRow`, so no document or task
    holds a whole large table."""
    chunked = rows.select(
        "table_id", F.floor(F.col("row_idx") / F.lit(rows_per_document)).cast("long").alias("chunk"),
        F.struct("row_idx", "names", F.transform("cells", lambda v: F.coalesce(v, F.lit(""))).alias("cells")).alias("_row"),
    )
    docs = chunked.groupBy("table_id", "chunk").agg(
        F.min("_row.row_idx").alias("firstRow"), F.sort_array(F.collect_list("_row")).alias("_rows")
    )
    if titles is not None:
        docs = docs.join(titles, "table_id", "left")
    else:
        docs = docs.withColumn("title", F.col("table_id"))
    return docs.select(
        F.col("table_id").alias("tableId"), F.coalesce("title", F.lit("")).alias("documentTitle"), "chunk", "firstRow",
        F.transform(F.get("_rows", F.lit(0))["names"], lambda n: F.struct(n.alias("text"))).alias("columns"),
        F.transform("_rows", lambda r: F.struct(F.transform(r["cells"], lambda v: F.struct(v.alias("text"))).alias("cells"))).alias("rows"),
    )


def file_title(caption: Column, table_id: Column) -> Column:
    """`{caption}_SEP_{id}` without slashes or a leading period."""
    clean = F.regexp_replace(F.replace(caption, F.lit("/"), F.lit(" ")), r"^\.", "_")
    return F.concat(clean, F.lit("_SEP_"), table_id)


def csv_line(values: Column) -> Column:
    """One CSV line; a field with quotes, commas or line breaks is quoted."""
    quoted = F.transform(
        values,
        lambda v: F.when(
            v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(v),
    )
    return F.array_join(quoted, ",")


def write_csv(nested: DataFrame, path: str) -> None:
    """One folder per table holding CSV files with their own header line."""
    lines = nested.select(
        file_title(F.col("documentTitle"), F.col("tableId")).alias("file_name"),
        F.explode(
            F.concat(
                F.array(csv_line(F.transform("columns", lambda c: c["text"]))),
                F.transform("rows", lambda r: csv_line(F.transform(r["cells"], lambda c: c["text"]))),
            )
        ).alias("value"),
    )
    lines.write.partitionBy("file_name").text(path)
