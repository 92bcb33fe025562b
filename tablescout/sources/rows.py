"""Every row of every table as a document, followed by the table's contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators.scaling import ordinal


def rows_as_documents(rows: DataFrame, contexts: DataFrame, row: str, order: str) -> DataFrame:
    """(doc_id, table_id, text): `{table}.csv_part_{i}`; contexts go on counting after the rows.

    rows(table_id, `row`, text) and contexts(table_id, `order`, text)."""
    numbered = ordinal(rows, "part", ["table_id"], row)
    later = ordinal(contexts, "_j", ["table_id"], order)
    sizes = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("_base"))
    after = later.join(sizes, "table_id", "left").withColumn("part", F.coalesce("_base", F.lit(0)) + F.col("_j"))
    parts = numbered.select("table_id", "part", "text").unionByName(after.select("table_id", "part", "text"))
    doc_id = F.concat("table_id", F.lit(".csv_part_"), F.col("part").cast("string"))
    return parts.select(doc_id.alias("doc_id"), "table_id", F.concat(doc_id, F.lit(": "), "text").alias("text"))
