"""Column and table profiling over the cell relation (table_id, row_idx, col_idx, col_name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.functions.hashing import draw, hash_rank
from tablescout.operators.scaling import fits, salted_join, small_side, top_per_group
from tablescout.session import materialize

# Hits a type needs before it is taken, and its order of preference.
TYPE_HITS = {"BOOL": 3, "INT": 3, "FLOAT": 3, "POLYGON": 1}
MAX_REPEATS = 100
MEAN_CELL_LIMIT = 2000
# Parts of column names that never join tables.
UNJOINABLE = ("year", "date", "time", "number", "score", "#")

COLUMN = ["table_id", "col_idx"]


def clean_headers(columns: DataFrame) -> DataFrame:
    """Adds `clean`, and `warnings` about what was replaced; blank names are counted per table."""
    w = Window.partitionBy("table_id").orderBy("col_idx")
    raw = F.col("col_name")
    numbered = columns.withColumn("_blank", F.sum(tx.is_blank_header(raw).cast("int")).over(w))
    s = tx.strip(raw)
    notes = F.array_compact(F.array(
        F.when(F.contains(s, F.lit(",")), "comma replaced"),
        F.when(F.contains(s, F.lit("(")), "opening parenthesis replaced"),
        F.when(F.contains(s, F.lit(")")), "closing parenthesis replaced"),
        F.when(F.length(tx.collapse_ws(F.translate(s, ",()", ".  "))) > tx.MAX_COLUMN_NAME, "name cut"),
    ))
    return numbered.withColumn("clean", tx.clean_header(raw, F.col("_blank"))).withColumn("warnings", notes).drop("_blank")


def _used_numbers(columns: DataFrame, key: str) -> DataFrame:
    """(table_id, stem, used): names of a table that end like a suffixed one, such as `a_7`, as stem and number."""
    keys = columns.select("table_id", F.col(key)).distinct()
    form = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,8})$"
    return keys.where(F.col(key).rlike(form)).select(
        "table_id", F.regexp_extract(key, form, 1).alias("stem"), F.regexp_extract(key, form, 2).cast("int").alias("used")
    )


def repair_duplicates(columns: DataFrame, name: str = "clean") -> DataFrame:
    """Adds `fixed`: later columns of one name (ignoring case) get `_2`, `_3`, ... skipping names in use; `error` where a
    name repeats too often to be repaired.

    The numbers a name may not take are joined to it and sorted; before the i-th of them (from 0) lie used - 2 - i free
    ones. A later column therefore moves on by as many places as there are used numbers with fewer free ones before
    them than it needs. No row carries the names of its table."""
    same = Window.partitionBy("table_id", "_key")
    w = columns.withColumn("_key", F.lower(name)).withColumns({
        "_n": F.row_number().over(same.orderBy("col_idx")), "_of": F.count(F.lit(1)).over(same),
    })
    tail = lambda s: F.concat(F.lit("_"), s.cast("string"))
    fits_ = lambda s: F.length(name) + F.length(tail(s)) < tx.MAX_COLUMN_NAME
    short = F.substring(F.col(name), F.lit(1), F.length(name) - 3)
    late = w.where((F.col("_n") > 1) & (F.col("_of") < MAX_REPEATS)).select("table_id", "col_idx", "_key", F.col(name), (F.col("_n") - 1).alias("_m"))
    # Columns of one name that differ in length (by odd capitals) form stems of their own.
    who = ["table_id", "_key", "_len"]
    late = late.withColumn("_len", F.length(name))
    forms = late.select(*who, F.col(name), F.explode(F.array(F.lit(True), F.lit(False))).alias("_whole")).dropDuplicates([*who, "_whole"])
    forms = forms.withColumn("stem", F.lower(F.when(F.col("_whole"), F.col(name)).otherwise(short)))
    taken = forms.join(_used_numbers(w, "_key"), ["table_id", "stem"]).where(fits_(F.col("used")) == F.col("_whole")).select(*who, "used").distinct()
    place = F.row_number().over(Window.partitionBy(*who).orderBy("used")) - 1
    events = taken.select(*who, F.lit(None).cast("int").alias("col_idx"), (F.col("used") - 2 - place).alias("_m"), F.lit(1).alias("_used"))
    asked = late.select(*who, F.col("col_idx").cast("int").alias("col_idx"), "_m", F.lit(0).alias("_used"))
    before = Window.partitionBy(*who).orderBy("_m", "_used").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = asked.unionByName(events).withColumn("_s", F.col("_m") + 1 + F.sum("_used").over(before)).where("_used = 0").select("table_id", "col_idx", "_s")
    suffixed = F.concat(F.when(fits_(F.col("_s")), F.col(name)).otherwise(short), tail(F.col("_s")))
    too_many = F.col("_of") >= MAX_REPEATS
    return w.join(numbers, ["table_id", "col_idx"], "left").select(
        *columns.columns, F.when(~too_many, F.when(F.col("_n") == 1, F.col(name)).otherwise(suffixed)).alias("fixed"),
        F.when(too_many, F.lit("name repeats too often")).alias("error"),
    )


def clip_cells(cells: DataFrame, limit: int = tx.MAX_CELL) -> DataFrame:
    return cells.withColumn("value", tx.clip_cell(F.col("value"), limit))


def title_and_id(path: Column, fallback: Column) -> tuple[Column, Column]:
    """Title and id from `title_SEP_id`; otherwise the name itself and the name with a suffix."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    tagged = F.contains(stem, F.lit("_SEP_"))
    title = F.when(tagged, F.get(F.split(stem, "_SEP_"), F.lit(0))).otherwise(stem)
    ident = F.when(tagged, F.get(F.split(stem, "_SEP_"), F.lit(1))).otherwise(F.concat(stem, F.lit("_"), fallback))
    return title, ident


def apply_side_car(tables: DataFrame, side_car: DataFrame, key: str = "stem") -> DataFrame:
    """Tables(key, table_id, title, col_names) with id, title and names of a side car where there is one.

    A side car naming a different number of columns rejects the table."""
    s = side_car.select(
        key, F.col("table_id").alias("_id"), F.col("title").alias("_title"), F.col("col_names").alias("_names")
    )
    wrong = F.col("_names").isNotNull() & (F.size("_names") != F.size("col_names"))
    return tables.join(s, key, "left").select(
        key, F.coalesce("_id", "table_id").alias("table_id"), F.coalesce("_title", "title").alias("title"),
        F.when(wrong, F.col("col_names")).otherwise(F.coalesce("_names", "col_names")).alias("col_names"),
        (~F.coalesce(wrong, F.lit(False))).alias("accepted"),
    )


def infer_types(cells: DataFrame) -> DataFrame:
    """(table_id, col_idx, infer_type): the type that first reaches its hits scanning rows downwards.

    Only the first three rows per column and type can decide, and each partition keeps
    just those before the shuffle; no column is sorted whole."""
    typed = cells.where(F.coalesce("value", F.lit("")) != "").withColumn("_type", tx.cell_type(F.col("value")))
    first = top_per_group(typed.select(*COLUMN, "row_idx", "_type"), [*COLUMN, "_type"], [F.col("row_idx")], 3, "_hit")
    needed = F.when(F.col("_type") == "POLYGON", TYPE_HITS["POLYGON"]).otherwise(3)
    reached = F.when((F.col("_type") != "Other") & (F.col("_hit") == needed), F.struct("row_idx", "_type"))
    return first.groupBy(*COLUMN).agg(F.min(reached).alias("_win")).select(
        *COLUMN, F.coalesce(F.col("_win._type"), F.lit("Other")).alias("infer_type")
    )


def numeric_columns(types: DataFrame) -> DataFrame:
    return types.where(F.col("infer_type").isin("INT", "FLOAT"))


def sampled_rows(table_rows: DataFrame, rows: int, seed=0, place: str = "_k") -> DataFrame:
    """At most `rows` rows per table, picked by hash, with their `place`. Every partition keeps so many of a table before
    anything moves, and only they are ever opened into cells."""
    key = hash_rank(seed, F.col("table_id"), F.col("row_idx"))
    return top_per_group(table_rows.withColumn("_d", key), ["table_id"], [F.col("_d"), F.col("row_idx")], rows, place).drop("_d")


def opened(table_rows: DataFrame) -> DataFrame:
    """The cells of rows(table_id, row_idx, names, cells)."""
    each = table_rows.select("table_id", "row_idx", F.posexplode(F.arrays_zip("names", "cells")).alias("col_idx", "_c"))
    return each.select("table_id", "row_idx", "col_idx", F.col("_c.names").alias("col_name"), F.col("_c.cells").alias("value"))


def sampled_cells(cells: DataFrame, rows: int, seed=0) -> DataFrame:
    """Cells of at most `rows` rows per table: rows(table_id, row_idx, names, cells) are sampled before they are opened;
    of a relation of cells the sampled rows are joined back."""
    if "cells" in cells.columns:
        return opened(sampled_rows(cells, rows, seed))
    keys = cells.where("col_idx = 0").select("table_id", "row_idx", hash_rank(seed, F.col("table_id"), F.col("row_idx")).alias("_d"))
    picked = top_per_group(keys, ["table_id"], [F.col("_d"), F.col("row_idx")], rows, "_k").select("table_id", "row_idx")
    return cells.join(picked, ["table_id", "row_idx"], "left_semi")


def oversized_columns(cells: DataFrame, rows: int = 30, limit: int = MEAN_CELL_LIMIT, seed=0) -> DataFrame:
    """Columns whose mean trimmed length over the sampled rows is above `limit`."""
    size = F.length(tx.strip(F.coalesce("value", F.lit(""))))
    return sampled_cells(cells, rows, seed).groupBy(*COLUMN).agg(F.avg(size).alias("mean_size")).where(F.col("mean_size") > limit)


def sample_columns(columns: DataFrame, most: int = 50, first: int = 5, seed=0) -> DataFrame:
    """All columns of a table, or its first five and random others when it has more than `most`."""
    w = Window.partitionBy("table_id").orderBy(
        (F.col("col_idx") >= first), F.when(F.col("col_idx") < first, F.lpad(F.col("col_idx").cast("string"), 6, "0")).otherwise(
            hash_rank(seed, F.col("table_id"), F.col("col_idx"))
        ), "col_idx"
    )
    return columns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def numeric_ranges(cells: DataFrame, rows: int = 100, seed=0) -> DataFrame:
    """(table_id, col_idx, lo, hi, all_int) of the numbers among the sampled rows."""
    v = tx.strip(F.col("value"))
    number = F.when(tx.is_int(v) | tx.is_float(v), v.cast("double"))
    return (
        sampled_cells(cells, rows, seed).select(*COLUMN, number.alias("_x"), tx.is_float(v).alias("_f")).where("_x is not null")
        .groupBy(*COLUMN)
        .agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), (~F.bool_or("_f")).alias("all_int"))
    )


def drawn_value(lo: Column, hi: Column, all_int: Column, u: Column) -> Column:
    """Text of a number drawn from [lo, hi]: whole numbers if the column has only those, else two decimals."""
    x = lo + (hi - lo) * u
    return F.when(all_int, x.cast("long").cast("string")).otherwise(F.format_string("%.2f", x))


def value_ranges(ranges: DataFrame, seed=0) -> DataFrame:
    """Adds `val`, `val_2`: an ordered pair of drawn numbers per column for BETWEEN."""
    a, b = draw(f"{seed}a", *map(F.col, COLUMN)), draw(f"{seed}b", *map(F.col, COLUMN))
    lo, hi, whole = F.col("lo"), F.col("hi"), F.col("all_int")
    return ranges.withColumn("val", drawn_value(lo, hi, whole, F.least(a, b))).withColumn(
        "val_2", drawn_value(lo, hi, whole, F.greatest(a, b))
    )


def complete_row(cells: DataFrame, needed: DataFrame, seed=0) -> DataFrame:
    """(question_id, table_id, row_idx): one row per question whose needed cells are all filled, drawn by hash.

    needed(question_id, table_id, col_idx), one table per question. Which rows are complete is found once per distinct set of
    columns of a table. Questions then meet those rows where they lie, and a partition hands on one row per question; a
    batch too large to send to the rows is joined on salted sets."""
    filled = (
        cells.where(tx.strip(F.coalesce("value", F.lit(""))) != "").groupBy("table_id", "row_idx").agg(F.collect_set("col_idx").alias("_have"))
    )
    asked = needed.groupBy("question_id", "table_id").agg(F.sort_array(F.collect_set("col_idx")).alias("_set"))
    kinds = asked.groupBy("table_id", "_set").agg(F.count(F.lit(1)).alias("_asking"))
    whole = filled.join(small_side(kinds.select("table_id", "_set")), "table_id").where(F.size(F.array_except("_set", "_have")) == 0)
    whole = whole.select("table_id", "_set", "row_idx")
    if fits(asked):
        met = whole.join(F.broadcast(asked), ["table_id", "_set"])
    else:
        counts = whole.groupBy("table_id", "_set").agg(F.count(F.lit(1)).alias("n"))
        met = salted_join(whole, asked, counts, ["table_id", "_set"], ["row_idx"])
    drawn = met.withColumn("_d", hash_rank(seed, F.col("question_id"), F.col("row_idx")))
    return top_per_group(drawn, ["question_id"], [F.col("_d"), F.col("row_idx")], 1, "_k").select(
        "question_id", "table_id", "row_idx"
    )


def joinable(cells: DataFrame, captions: DataFrame, first_columns: int = 6, keys_per_column: int = 10) -> DataFrame:
    """(col_key, text_key, table_id, caption): texts shared by several tables under one column name.

    Tables are counted, never collected, so a value found in every table stays distributed."""
    name = F.lower(tx.strip(F.col("col_name")))
    blocked = F.lit(False)
    for part in UNJOINABLE:
        blocked = blocked | F.contains("col_name", F.lit(part))
    text = tx.strip(F.col("value"))
    # Every value of a table once; read for the counts and for the tables of the chosen values.
    seen = materialize(
        cells.where((F.col("col_idx") < first_columns) & ~blocked & (text != "") & ~tx.is_float(text))
        .groupBy(name.alias("col_key"), F.lower(text).alias("text_key"), "table_id")
        .agg(F.min("row_idx").alias("_row")), "table-values",
    )
    shared = seen.groupBy("col_key", "text_key").agg(
        F.count(F.lit(1)).alias("_tables"), F.min(F.struct("table_id", "_row")).alias("_first")
    ).where("_tables > 1")
    top = top_per_group(shared, ["col_key"], [F.col("_first"), F.col("text_key")], keys_per_column, "_k")
    chosen = top.select("col_key", "text_key", F.col("_tables").alias("n"))
    found = salted_join(
        seen.select("col_key", "text_key", "table_id"), chosen.drop("n"), chosen, ["col_key", "text_key"], ["table_id"]
    )
    return found.join(captions, "table_id").select("col_key", "text_key", "table_id", "caption")


def row_counts(cells: DataFrame) -> DataFrame:
    """Rows that are there, one per first cell; row numbers may have gaps."""
    return cells.where("col_idx = 0").groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"))
