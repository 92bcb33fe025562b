"""Source and sink queries (SRC): driver tables travel through files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.plans.lake import CELLS_SQL, LAKE, lake_columns, lake_rows, plain
from tablescout.plans.registry import query, table
from tablescout.session import scratch_path
from tablescout.sources import files as S
from tablescout.sources import nested as NT
from tablescout.sources.rows import rows_as_documents


@query("src_01", "select doc_id, text, lang, source, n_chars from documents")
def csv_scan(spark, sf):
    """Texts with quotes and line breaks survive the round trip; types are inferred."""
    path = scratch_path(spark, "csv")
    S.write_csv(table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars", by="doc_id"), path)
    back = S.read_csv(spark, path)
    return back.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("n_chars", F.col("n_chars").cast("long"))


@query("src_02", "select * from orders")
def parquet_scan(spark, sf):
    return S.read_parquet(spark, f"{sf}/orders.parquet")


@query("src_03", "select c_custkey, c_name, c_acctbal from customer")
def object_store_scan(spark, sf):
    """The object-store reader over a local address: only the address differs."""
    return S.read_object_store(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


_LAKE_OUT = f"""with {CELLS_SQL}
select table_id, count(distinct row_idx) as n_rows, count(distinct col_idx) as n_cols, count(*) as n_cells,
  min(value) as low, max(value) as high, count(*) filter (value is null) as n_null from cells group by table_id"""


@query("src_04", f"""select * from ({_LAKE_OUT}) union all
select 'rejected', (select count(*) from region), 0, 0, null, null, 0""")
def recursive_lake(spark, sf):
    """Tables in nested folders as CSV or Parquet plus files of a foreign type, read by one scan."""
    root = scratch_path(spark, "lake")
    for i, (name, (_, columns)) in enumerate(LAKE.items()):
        df = table(spark, sf, name, *columns)
        named = df.toDF(*[plain(c) for c in columns])
        if i % 2:
            named.write.parquet(f"{root}/inner/deep/{name}")
        else:
            S.write_csv(named.select([F.col(c).cast("string") for c in named.columns]), f"{root}/inner/{name}")
    table(spark, sf, "region").select(F.col("r_name").alias("value"), "r_regionkey").write.partitionBy(
        "r_regionkey"
    ).text(f"{root}/junk")
    cells = S.lake_cells(spark, root).withColumn("table_id", F.element_at(F.split("table_id", "/"), -2))
    good = cells.groupBy("table_id").agg(
        F.countDistinct("row_idx").alias("n_rows"), F.countDistinct("col_idx").alias("n_cols"),
        F.count(F.lit(1)).alias("n_cells"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
    )
    rejected = S.file_outcomes(S.list_files(spark, root)).where("not accepted").agg(
        F.lit("rejected").alias("table_id"), F.count(F.lit(1)).alias("n_rows"), F.lit(0).alias("n_cols"),
        F.lit(0).alias("n_cells"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"),
        F.lit(0).alias("n_null"),
    )
    return good.unionByName(rejected)


_STRIP = "trim(text, E' \\t\\n\\r\\f\\v')"


def write_item_texts(spark, sf, path):
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)


@query("src_05", f"select item_id, {_STRIP} as value from benchmark")
def text_metadata(spark, sf):
    path = scratch_path(spark, "texts")
    write_item_texts(spark, sf, path)
    return S.read_texts(spark, path).select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "value"
    )


@query("src_06", f"select source as table_id, {_STRIP} as value from documents")
def metadata_csv(spark, sf):
    path = scratch_path(spark, "metadata")
    S.write_csv(
        table(spark, sf, "documents", "doc_id", "source", "text", by="doc_id").select(
            F.col("source").alias("table_id"), F.col("text").alias("value")
        ),
        path,
    )
    return S.read_metadata_csv(spark, path)


@query("src_07", f"""select 'txt' as kind, 'benchmark' as table_id, {_STRIP} as value from benchmark
union all select 'csv', source, {_STRIP} from documents""")
def metadata_folder(spark, sf):
    root = scratch_path(spark, "metadata")
    write_item_texts(spark, sf, f"{root}/a/texts")
    S.write_csv(
        table(spark, sf, "documents", "doc_id", "source", "text", by="doc_id").select(
            F.col("source").alias("table_id"), F.col("text").alias("value")
        ),
        f"{root}/b",
    )
    return S.read_metadata_folder(spark, root, "benchmark")


@query("src_08", "select * from events")
def jsonl(spark, sf):
    events = table(spark, sf, "events")
    path = scratch_path(spark, "jsonl")
    S.write_jsonl(events, path)
    return S.read_jsonl(spark, path, events.schema)


def nested_lake(spark, sf, rows_per_document=1000):
    return NT.nest_rows(lake_rows(spark, sf), rows_per_document=rows_per_document)


@query("src_09", f"with {CELLS_SQL} select table_id, row_idx, col_idx, col_name, value from cells")
def nested_source(spark, sf):
    path = scratch_path(spark, "nested")
    S.write_jsonl(nested_lake(spark, sf), path)
    return NT.cells_of_nested(NT.read_nested(spark, path))


@query("src_10", f"""with {CELLS_SQL}
select table_id, row_idx // 1000 as chunk, min(row_idx) as first_row, count(distinct col_idx) as n_cols,
  count(distinct row_idx) as n_rows, md5(string_agg(value, '|' order by row_idx, col_idx)) as digest
from cells group by all""")
def nested_conversion(spark, sf):
    cells = F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"])))
    return nested_lake(spark, sf).select(
        F.col("tableId").alias("table_id"), "chunk", F.col("firstRow").alias("first_row"),
        F.size("columns").alias("n_cols"), F.size("rows").alias("n_rows"), F.md5(F.array_join(cells, "|")).alias("digest"),
    )


@query("src_11", f"""with {CELLS_SQL}, ln as (
  select table_id, row_idx, string_agg(value, ',' order by col_idx) as line from cells group by all)
select '_' || replace(table_id, 'r', ' r') || '_SEP_' || table_id as file_name, count(*) as n_lines, max(line) as last_line
from ln group by all""")
def csv_sink(spark, sf):
    """Captions start with a period and hold slashes, which the file name may not."""
    titles = lake_columns(spark, sf).select("table_id").distinct().withColumn(
        "title", F.concat(F.lit("."), F.replace("table_id", F.lit("r"), F.lit("/r")))
    )
    docs = NT.nest_rows(lake_rows(spark, sf), titles)
    path = scratch_path(spark, "sink")
    NT.write_csv(docs, path)
    lines = spark.read.option("basePath", path).text(path)
    headers = [",".join(plain(c) for c in columns) for _, columns in LAKE.values()]
    return lines.where(~F.col("value").isin(headers)).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("value").alias("last_line")
    )


@query("src_12", "select page_id, html || chr(10) as text from pages")
def whole_files(spark, sf):
    path = scratch_path(spark, "pages")
    S.write_whole_files(table(spark, sf, "pages", "page_id", "html"), path, "page_id", "html")
    return S.read_whole_files(spark, path, "*.txt").select(
        F.regexp_extract("path", r"(?:page_id=|/)(\d+)(?:\.txt|/[^/]*)$", 1).cast("long").alias("page_id"), "text"
    )


@query("src_13", """
with r as (select source as table_id, row_number() over (partition by source order by doc_id) - 1 as part,
             'lang: ' || lang || ', n_chars: ' || n_chars || ', text: ' || text as text from documents),
b as (select table_id, count(*) as base from r group by table_id),
c as (select source as table_id, row_number() over (partition by source order by doc_id) - 1 as j,
             'quality ' || quality || ' toxic ' || toxic as text from labels join documents using (doc_id)),
a as (select table_id, part, text from r union all select table_id, base + j, text from c join b using (table_id))
select table_id || '.csv_part_' || part as doc_id, table_id, table_id || '.csv_part_' || part || ': ' || text as text from a""")
def all_rows(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars", "text", by="doc_id")
    rows = docs.select(
        F.col("source").alias("table_id"), "doc_id",
        F.concat(F.lit("lang: "), "lang", F.lit(", n_chars: "), F.col("n_chars").cast("string"), F.lit(", text: "), "text").alias("text"),
    )
    contexts = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("table_id"), "doc_id",
        F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string")).alias("text"),
    )
    return rows_as_documents(rows, contexts, "doc_id", "doc_id")


@query("src_14", """select '{"dataset":"events","timestamp":"run-1","results":{"event_type":"' || event_type || '","n":' || count(*)
  || ',"users":' || count(distinct user_id) || '}}' as value from events group by event_type""")
def metrics_sink(spark, sf):
    results = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")
    )
    path = scratch_path(spark, "metrics")
    S.write_metrics(results, path, "events", F.lit("run-1"))
    return spark.read.text(path)
