"""Profiling and ground-truth queries (GEN-01..11, 15..20, 32, 35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.functions.text import norm_text
from tablescout.operators import groundtruth as GT
from tablescout.operators import profile as PR
from tablescout.plans.lake import CELLS_SQL, COLUMNS_SQL, lake_cells, lake_columns, lake_rows
from tablescout.plans.registry import query, table
from tablescout.session import materialize

WS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda t: t <> '')"


def strip_sql(c: str) -> str:
    return f"trim({c}, E' \\t\\n\\r\\f\\v')"


def cut_sql(c: str, limit: int) -> str:
    w = WS.format(c)
    k = f"len(list_filter(generate_series(1, least(len({w}), {limit})), lambda i: length(array_to_string(list_slice({w}, 1, i), ' ')) <= {limit}))"
    return f"case when {k} > 0 then array_to_string(list_slice({w}, 1, {k}), ' ') else substr({c}, 1, {limit}) end"


# ---- headers and cells: the lines of a document stand for the column names of a table ----------

_LINES_SQL = """ln as (select doc_id as table_id, (generate_subscripts(p, 1) - 1)::int as col_idx, unnest(p) as col_name
  from (select doc_id, string_split(text, chr(10)) as p from documents))"""


def line_columns(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", by="doc_id")
    return docs.select(F.col("doc_id").alias("table_id"), F.posexplode(F.split("text", "\n")).alias("col_idx", "col_name"))


_COLLAPSED = r"array_to_string(list_filter(regexp_split_to_array(translate(n, ',()', '.  '), '\s+'), lambda t: t <> ''), ' ')"


@query("gen_01", f"""with {_LINES_SQL},
b as (select *, {strip_sql('col_name')} as s, {strip_sql('col_name')} in ('', '`') as blank from ln),
n as (select *, case when blank then 'unk_' || sum(blank::int) over (partition by table_id order by col_idx) else s end as n from b),
c as (select *, {_COLLAPSED} as c from n)
select table_id, col_idx, case when length(c) > 64 then {cut_sql('c', 64)} else c end as clean,
  contains(s, ',')::int + contains(s, '(')::int + contains(s, ')')::int
  + (length(array_to_string(list_filter(regexp_split_to_array(translate(s, ',()', '.  '), '\\s+'), lambda t: t <> ''), ' ')) > 64)::int as n_warnings from c""")
def header_cleaning(spark, sf):
    return PR.clean_headers(line_columns(spark, sf)).select(
        "table_id", "col_idx", "clean", F.size("warnings").alias("n_warnings")
    )


@query("gen_02", r"""
with w as (select conv_id * 1000 + turn as table_id, (generate_subscripts(p, 1) - 1)::int as col_idx, unnest(p) as name
  from (select conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as p from conversations)),
k as (select *, lower(name) as key, row_number() over (partition by table_id, lower(name) order by col_idx) as n,
        count(*) over (partition by table_id, lower(name)) as cnt from w),
nm as (select table_id, list_distinct(list(key)) as names from k group by table_id)
select table_id, col_idx, case when cnt >= 100 then null when n = 1 then name else
  (case when length(name) + length('_' || f) < 64 then name else substr(name, 1, length(name) - 3) end) || '_' || f end as fixed
from (select k.*, list_filter(generate_series(2, 2 + cnt + len(names)), lambda s: not list_contains(names,
        lower((case when length(name) + length('_' || s) < 64 then name else substr(name, 1, length(name) - 3) end) || '_' || s)))[n - 1] as f
      from k join nm using (table_id))""")
def header_repair(spark, sf):
    """The words of a message stand for column names, which repeat."""
    words = table(spark, sf, "conversations", "conv_id", "turn", "text", by="conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("table_id"), F.posexplode(tx.split_ws(F.col("text"))).alias("col_idx", "name")
    )
    return PR.repair_duplicates(words, "name").select("table_id", "col_idx", "fixed")


@query("gen_03", f"""
with w as (select doc_id, {strip_sql('text')} as s, list_slice({WS.format(strip_sql('text'))}, 1, 128) as w from documents),
k as (select *, len(list_filter(generate_series(1, len(w)), lambda i: length(array_to_string(list_slice(w, 1, i), ' ')) <= 128)) as k from w)
select doc_id, case when length(s) <= 128 then s when k > 0 then array_to_string(list_slice(w, 1, k), ' ') else substr(s, 1, 128) end as value from k""")
def cell_truncation(spark, sf):
    return PR.clip_cells(table(spark, sf, "documents", "doc_id", F.col("text").alias("value"), by="doc_id"))


@query("gen_04", """select doc_id, case when doc_id % 2 = 0 then source else source || '-' || doc_id end as title,
  case when doc_id % 2 = 0 then doc_id::varchar else source || '-' || doc_id || '_' || md5(doc_id::varchar) end as table_id from documents""")
def titles(spark, sf):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/lake/a/"), "source", F.lit("_SEP_"), n, F.lit(".csv"))).otherwise(
        F.concat(F.lit("/lake/"), "source", F.lit("-"), n, F.lit(".csv"))
    )
    title, ident = PR.title_and_id(path, F.md5(n))
    return table(spark, sf, "documents", "doc_id", "source").select("doc_id", title.alias("title"), ident.alias("table_id"))


@query("gen_05", """select d.doc_id as stem, case when l.doc_id is null then source else 'id' || l.doc_id end as table_id,
  coalesce('quality ' || quality, lang) as title, case when quality = 1 then 'a,b' else 'lang,source' end as names,
  coalesce(quality, 1) = 1 as accepted from documents d left join labels l using (doc_id)""")
def side_car(spark, sf):
    """Documents with a quality of 0 get a side car naming one column too many."""
    tables = table(spark, sf, "documents", "doc_id", "source", "lang").select(
        F.col("doc_id").alias("stem"), F.col("source").alias("table_id"), F.col("lang").alias("title"),
        F.array(F.lit("lang"), F.lit("source")).alias("col_names"),
    )
    names = F.when(F.col("quality") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    cars = table(spark, sf, "labels").select(
        F.col("doc_id").alias("stem"), F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("table_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("title"), names.alias("col_names"),
    )
    out = PR.apply_side_car(tables, cars)
    return out.select("stem", "table_id", "title", F.array_join("col_names", ",").alias("names"), "accepted")


def types_sql(cells: str = "cells") -> str:
    return rf"""
ct as (select table_id, col_idx, row_idx, case when lower(trim(value)) in ('true', 'false', 't', 'f') then 'BOOL'
   when regexp_matches(trim(value), '^[+-]?[0-9]+$') then 'INT' when regexp_matches(trim(value), '^-?[0-9]+\.[0-9]+$') then 'FLOAT'
   when regexp_matches(lower(trim(value)), '^multipolygon[0-9(), .]*$') then 'POLYGON' else 'Other' end as t
   from {cells} where coalesce(value, '') <> ''),
cc as (select *, count(*) over (partition by table_id, col_idx, t order by row_idx) as running from ct),
ty as (select table_id, col_idx, coalesce(arg_min(t, row_idx) filter (t <> 'Other' and running >= case t when 'POLYGON' then 1 else 3 end), 'Other') as infer_type
   from cc group by all)"""


TYPES_SQL = types_sql()


@query("gen_06", f"with {CELLS_SQL}, {TYPES_SQL} select table_id, col_idx, infer_type from ty")
def type_inference(spark, sf):
    return PR.infer_types(lake_cells(spark, sf))


@query("gen_07", f"with {CELLS_SQL}, {TYPES_SQL} select table_id, col_idx, infer_type from ty where infer_type in ('INT', 'FLOAT')")
def numeric_columns(spark, sf):
    return PR.numeric_columns(PR.infer_types(lake_cells(spark, sf)))


@query("gen_08", """
with p as (select source as table_id, doc_id, text, lang from documents
           qualify row_number() over (partition by source order by md5('0|' || source || '|' || doc_id), doc_id) <= 30)
select table_id, 0 as col_idx, round(avg(length(trim(text, E' \\t\\n\\r\\f\\v'))), 4) as mean_size from p group by 1 having mean_size > 2000
union all select table_id, 1, avg(length(lang)) as m from p group by 1 having m > 2000""")
def oversized(spark, sf):
    docs = table(spark, sf, "documents", "source", "doc_id", "text", "lang", by="doc_id")
    rows = docs.select(
        F.col("source").alias("table_id"), F.col("doc_id").alias("row_idx"), F.array(F.lit("text"), F.lit("lang")).alias("names"),
        F.array("text", "lang").alias("cells"),
    )
    return PR.oversized_columns(rows).withColumn("mean_size", F.round("mean_size", 4))


@query("gen_09", """
with c as (select vec_id as table_id, (unnest(generate_series(1, len(embedding))) - 1)::int as col_idx from embeddings)
select table_id, col_idx from c qualify row_number() over (partition by table_id order by col_idx >= 5,
  case when col_idx < 5 then lpad(col_idx::varchar, 6, '0') else md5('0|' || table_id || '|' || col_idx) end, col_idx) <= 50""")
def column_sampling(spark, sf):
    """Vectors as wide tables of 64 columns."""
    wide = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("table_id"), F.posexplode("embedding").alias("col_idx", "_v")
    ).drop("_v")
    return PR.sample_columns(wide)


def sampled_sql(rows: int, seed: int = 0, keys: str = "sk", out: str = "sc") -> str:
    return f"""
{keys} as (select table_id, row_idx from cells where col_idx = 0
  qualify row_number() over (partition by table_id order by md5('{seed}|' || table_id || '|' || row_idx), row_idx) <= {rows}),
{out} as (select cells.* from cells join {keys} using (table_id, row_idx))"""


RANGES_SQL = rf"""{sampled_sql(100)},
rg as (select table_id, col_idx, min(x) as lo, max(x) as hi, not bool_or(f) as all_int from (
  select table_id, col_idx, regexp_matches(trim(value), '^-?[0-9]+\.[0-9]+$') as f,
    case when regexp_matches(trim(value), '^[+-]?[0-9]+$') or regexp_matches(trim(value), '^-?[0-9]+\.[0-9]+$') then value::double end as x from sc)
  where x is not null group by all)"""


def draw_sql(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::bigint / 4294967296.0::double)"


def drawn_sql(lo: str, hi: str, whole: str, u: str) -> str:
    x = f"({lo} + ({hi} - {lo}) * {u})"
    return f"case when {whole} then trunc({x})::bigint::varchar else printf('%.2f', {x}) end"


_A, _B = draw_sql("'0a'", "table_id", "col_idx"), draw_sql("'0b'", "table_id", "col_idx")


@query("gen_10", f"""with {CELLS_SQL}, {RANGES_SQL}
select table_id, col_idx, {drawn_sql('lo', 'hi', 'all_int', f'least({_A}, {_B})')} as val,
  {drawn_sql('lo', 'hi', 'all_int', f'greatest({_A}, {_B})')} as val_2 from rg""")
def range_sampling(spark, sf):
    ranges = PR.numeric_ranges(lake_rows(spark, sf))
    return PR.value_ranges(ranges).select("table_id", "col_idx", "val", "val_2")


@query("gen_11", """
select source as question_id, source as table_id, doc_id as row_idx from documents join labels using (doc_id)
qualify row_number() over (partition by source order by md5('0|' || source || '|' || doc_id), doc_id) = 1""")
def complete_rows(spark, sf):
    """Every source asks for a row with language and quality; only labelled rows have both."""
    docs = table(spark, sf, "documents", "doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    cells = docs.select(
        F.col("source").alias("table_id"), F.col("doc_id").alias("row_idx"),
        F.posexplode(F.array("lang", F.col("quality").cast("string"))).alias("col_idx", "value"),
    )
    needed = docs.select(F.col("source").alias("table_id")).distinct().select(
        F.col("table_id").alias("question_id"), "table_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("col_idx")
    )
    return PR.complete_row(cells, needed)


@query("gen_20", rf"""with {CELLS_SQL},
s as (select lower(col_name) as col_key, lower(trim(value)) as text_key, table_id, min(row_idx) as r from cells
  where col_idx < 6 and trim(value) <> '' and not regexp_matches(trim(value), '^-?[0-9]+\.[0-9]+$')
    and not regexp_matches(col_name, 'year|date|time|number|score|#') group by all),
h as (select col_key, text_key, min((table_id, r)) as first from s group by all having count(*) > 1),
k as (select col_key, text_key from h qualify row_number() over (partition by col_key order by first, text_key) <= 10)
select col_key, text_key, table_id, 'Table ' || table_id as caption from s join k using (col_key, text_key)""")
def joinable_tables(spark, sf):
    cells = lake_cells(spark, sf)
    captions = lake_columns(spark, sf).where("col_idx = 0").select("table_id", F.concat(F.lit("Table "), "table_id").alias("caption"))
    return PR.joinable(cells, captions)


@query("gen_35", f"with {CELLS_SQL} select table_id, count(distinct row_idx) as n_rows from cells group by 1")
def row_counts(spark, sf):
    return PR.row_counts(lake_cells(spark, sf))


# ---- ground truth: every supplier asks for names under its nation (even ones: and its balance) --

_Q_SQL = """
qs as (select s_suppkey::varchar as question_id, s_suppkey as row_idx, s_nationkey::varchar as nat, s_acctbal::varchar as bal,
  s_suppkey % 2 = 0 as even from supplier),
rf as (select question_id, 'name' as name from qs union all select question_id, 'nationkey' from qs
  union all select question_id, 'acctbal' from qs where even),
ix as (select distinct col_name as name, table_id from cells where col_name in (select name from rf)),
nd as (select question_id, count(*) as need from rf group by 1),
sh as (select question_id, table_id from rf join ix using (name) join nd using (question_id) group by question_id, table_id, need
  having count(distinct name) = need)"""


def supplier_questions(spark, sf):
    s = table(spark, sf, "supplier")
    cond = lambda name, value: F.struct(
        F.lit(name).alias("col_name"), F.lit("=").alias("op"), F.col(value).cast("string").alias("val"),
        F.col("s_suppkey").cast("long").alias("row"),
    )
    nation, balance = cond(" NationKey", "s_nationkey"), cond("acctbal ", "s_acctbal")
    none = F.lit(None).cast("struct<col_name:string>")
    struct = F.struct(
        F.array(F.struct(F.lit("Name").alias("col_name"))).alias("select"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(nation, balance)).otherwise(F.array(nation)).alias("where"),
        none.alias("group_by"), none.alias("having"), none.alias("order_by"),
    )
    return s.select(F.col("s_suppkey").cast("string").alias("question_id"), F.lit("supplier").alias("table_id"), struct.alias("sql_struct"))


def shared_tables(spark, sf):
    refs = GT.referenced_columns(supplier_questions(spark, sf))
    return GT.schema_shared_tables(refs, GT.column_index(lake_columns(spark, sf), refs))


@query("gen_15", f"with {CELLS_SQL}, {_Q_SQL} select question_id, name from rf")
def references(spark, sf):
    return GT.referenced_columns(supplier_questions(spark, sf))


@query("gen_16", f"with {CELLS_SQL}, {_Q_SQL} select name, table_id from ix")
def inverted_columns(spark, sf):
    return GT.column_index(lake_columns(spark, sf), GT.referenced_columns(supplier_questions(spark, sf)))


@query("gen_17", f"with {CELLS_SQL}, {_Q_SQL} select question_id, table_id from sh")
def shared_by_schema(spark, sf):
    return shared_tables(spark, sf)


# Balances in half thousands with two decimals in the cells ("1.50") and as plain floats in the conditions ("1.5").
_HALVES = "round(({} + 1000) / 1000) / 2"


def coarse_cells(spark, sf):
    halves = F.round((F.col("value").cast("double") + 1000) / 1000) / 2
    return lake_cells(spark, sf).withColumn(
        "value", F.when(F.col("col_name") == "acctbal", F.format_string("%.2f", halves)).otherwise(F.col("value"))
    )


@query("gen_18", rf"""with {CELLS_SQL}, {_Q_SQL},
cc as (select table_id, row_idx, col_name, case when col_name = 'acctbal' then printf('%.2f', {_HALVES.format('value::double')}) else value end as value from cells),
fc as (select distinct table_id, row_idx, col_name, unnest([value, case when regexp_matches(value, '^-?[0-9]+\.[0-9]+$') then value::double::varchar else value end]) as v
  from cc),
cn as (select question_id, 1 as c, 'nationkey' as name, nat as v from qs
  union all select question_id, 2, 'acctbal', ({_HALVES.format('bal::double')})::varchar from qs where even),
mt as (select distinct cn.question_id, c, fc.table_id, fc.row_idx from cn join fc on fc.col_name = cn.name and fc.v = cn.v),
cd as (select question_id, count(*) as need from cn group by 1),
ok as (select question_id, table_id, row_idx from mt join cd using (question_id) where table_id <> 'supplier' and (question_id, table_id) in (select question_id, table_id from sh)
  group by question_id, table_id, row_idx, need having count(*) = need),
an as (select question_id, table_id, row_idx from ok union all select question_id, 'supplier', row_idx from qs),
ar as (select question_id, table_id, string_agg(row_idx::varchar, ',' order by row_idx) as rows from an group by all)
select question_id, table_id, rows, (select count(*) from sh where sh.question_id = ar.question_id) - count(*) over (partition by question_id) as filter_by_cell
from ar""")
def verified_cells(spark, sf):
    questions = supplier_questions(spark, sf)
    conditions = questions.select("question_id", F.explode("sql_struct.where").alias("c")).where("c.op = '='").select(
        "question_id", F.col("c.col_name").alias("name"), F.col("c.val").alias("value"), F.col("c.row").alias("row_idx")
    )
    halves = (F.round((F.col("value").cast("double") + 1000) / 1000) / 2).cast("string")
    conditions = conditions.withColumn("value", F.when(norm_text(F.col("name")) == "acctbal", halves).otherwise(F.col("value")))
    shared = materialize(shared_tables(spark, sf), "shared")
    return GT.cell_answers(
        questions.select("question_id", "table_id"), conditions, shared, coarse_cells(spark, sf),
        show=lambda rows: F.array_join(rows.cast("array<string>"), ","),
    )


_TITLES_SQL = """
tq as (select item_id as question_id, (item_id * 7) % (select count(*) from documents) as table_id, split_part(text, ' ', 1) as entity from benchmark),
ti as (select doc_id as table_id, left(text, 200) as title from documents),
pr as (select tq.question_id, ti.table_id, entity, title, tq.table_id as src from tq join ti on ti.table_id % 40 = tq.question_id % 40)"""
_PLAIN = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''), ' ') || ' '"


@query("gen_19", f"""with {_TITLES_SQL},
jd as (select question_id, table_id, src, contains({_PLAIN.format('title')}, {_PLAIN.format('entity')}) and {_PLAIN.format('entity')} <> '  ' as yes
  from pr where table_id <> src),
rm as (select question_id, count(*) filter (not yes) as n from jd group by 1),
kp as (select question_id, table_id from jd where yes union all select question_id, table_id from tq)
select question_id, table_id, coalesce(n, 0)::bigint as filter_by_title from kp left join rm using (question_id)""")
def title_verification(spark, sf):
    """Questions ask for documents whose beginning mentions their first word; candidates are every 40th document."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    questions = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), ((F.col("item_id") * 7) % docs.count()).alias("table_id"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("entity"),
    )
    titles = docs.select(F.col("doc_id").alias("table_id"), F.substring("text", 1, 200).alias("title"))
    shared = titles.join(
        F.broadcast(questions.select("question_id", "entity", (F.col("question_id") % 40).alias("_m"))), F.col("table_id") % 40 == F.col("_m")
    ).drop("_m")
    shared = materialize(shared, "titles")
    asked = shared.join(questions.select("question_id", F.col("table_id").alias("_src")), "question_id").where("table_id <> _src").drop("_src")
    return GT.verify_titles(questions, shared, GT.judge_titles(asked))


@query("gen_32", f"""with {COLUMNS_SQL},
q as (select c_custkey, case c_custkey % 3 when 0 then 'supplier' else 'customer' end as table_id, case when c_custkey % 2 = 0 then 'mktsegment' else 'name' end as name from customer)
select c_custkey, table_id from q where exists (select 1 from cols where cols.table_id = q.table_id and cols.col_name = q.name)""")
def reference_validation(spark, sf):
    """Customers ask about their segment or name, some of them in the wrong table."""
    q = table(spark, sf, "customer", "c_custkey").select(
        F.col("c_custkey").alias("question_id"),
        F.when(F.col("c_custkey") % 3 == 0, "supplier").otherwise("customer").alias("table_id"),
        F.when(F.col("c_custkey") % 2 == 0, "mktsegment").otherwise("name").alias("name"),
    )
    valid = GT.valid_questions(q.select("question_id", "table_id"), q, lake_columns(spark, sf))
    return valid.withColumnRenamed("question_id", "c_custkey")
