"""Benchmark generation queries (GEN-12..14, 21..31, 33, 34, 36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.operators import benchgen as BG
from tablescout.operators import documents as D
from tablescout.operators import profile as PR
from tablescout.plans.lake import CELLS_SQL, COLUMNS_SQL, lake_columns, lake_rows
from tablescout.plans.profiling import RANGES_SQL, draw_sql, drawn_sql, sampled_sql, strip_sql, types_sql
from tablescout.plans.registry import query, table
from tablescout.plans.retrieval import terms_sql
from tablescout.session import materialize


PROMPT_ROWS = 10


# ---- sampled question structures ---------------------------------------------------------------

def u_sql(tag: str, *more: str) -> str:
    return draw_sql("'7'", "table_id", "attempt", f"'{tag}'", *more)


def pick_sql(items: str, tag: str) -> str:
    return f"{items}[1 + floor({u_sql(tag)} * len({items}))::int]"


def choice_sql(values: list, tag: str, *more: str) -> str:
    return f"({values})[1 + floor({u_sql(tag, *more)} * {len(values)})::int]"


def shuffled_sql(items: str, tag: str) -> str:
    key = f"md5('7|' || table_id || '|' || attempt || '|{tag}|' || c.col_idx)"
    return f"list_transform(list_sort(list_transform({items}, lambda c: {{'d': {key}, 'c': c}})), lambda x: x.c)"


def number_sql(c: str, tag: str) -> tuple[str, str, str]:
    a, b = u_sql(tag + "1", f"{c}.col_idx"), u_sql(tag + "2", f"{c}.col_idx")
    lo, hi, whole = f"{c}.lo", f"{c}.hi", f"{c}.all_int"
    return (
        drawn_sql(lo, hi, whole, a), drawn_sql(lo, hi, whole, f"least({a}, {b})"), drawn_sql(lo, hi, whole, f"greatest({a}, {b})"),
    )


_ONE, _LOW, _HIGH = number_sql("c", "v")
_H1, _HL, _HH = number_sql("a1", "h")
_OP = f"case when c.numeric then {choice_sql(BG.PREDICATES, 'op', 'c.col_idx')} else '=' end"

STRUCT_SQL = f"""{CELLS_SQL}, cols as (select distinct table_id, col_idx, col_name from cells),
{sampled_sql(10, keys="pk", out="pr")}, {types_sql("pr")}, {RANGES_SQL},
pc as (select table_id, list({{'col_idx': col_idx, 'col_name': col_name, 'numeric': infer_type in ('INT', 'FLOAT'), 'lo': lo, 'hi': hi, 'all_int': all_int}} order by col_idx) as cols
  from cols join ty using (table_id, col_idx) left join rg using (table_id, col_idx) group by table_id),
a0 as (select *, list_filter(cols, lambda c: c.numeric) as num, list_filter(cols, lambda c: not c.numeric) as txt
  from pc, (select unnest(generate_series(0, 9)) as attempt)),
a1 as (select *, len(num) > 0 and {u_sql('aggr')} < 0.5 as is_aggr from a0),
a2 as (select *, case when is_aggr then {pick_sql('num', 'a1')} end as a1, {choice_sql(BG.AGGREGATES, 'op1')} as op1,
  case when is_aggr and len(txt) > 0 and {u_sql('group')} < 0.2 then {pick_sql('txt', 'g')} end as g from a1),
a3 as (select *, list_filter(num, lambda c: c.col_idx <> a1.col_idx) as others from a2),
a4 as (select *, case when is_aggr and g is null and len(num) > 1 and {u_sql('second')} < 0.5 then {pick_sql('others', 'a2')} end as b2,
  g is not null and {u_sql('having')} < 0.8 as has,
  case when not is_aggr and len(num) > 0 and {u_sql('order')} < 0.2 then {pick_sql('num', 'o')} end as o,
  {shuffled_sql('cols', 'sel')} as ssel, {shuffled_sql('cols', 'pred')} as spred from a3),
a5 as (select *, case when is_aggr then list_filter([case when g is not null then {{'col': g.col_idx, 'col_name': g.col_name, 'aggr': null::varchar}} end,
    {{'col': a1.col_idx, 'col_name': a1.col_name, 'aggr': op1}},
    case when b2 is not null then {{'col': b2.col_idx, 'col_name': b2.col_name, 'aggr': {choice_sql(BG.AGGREGATES, 'op2')}}} end], lambda x: x is not null)
  else list_transform(list_slice(ssel, 1, case when {u_sql('nsel')} < 0.5 then 1 else 2 end), lambda c: {{'col': c.col_idx, 'col_name': c.col_name, 'aggr': null::varchar}}) end as sel,
  case when is_aggr or o is not null then case when {u_sql('npred')} < 0.1 then 0 when {u_sql('npred')} < 0.55 then 1 else 2 end
       else case when {u_sql('npred')} < 0.5 then 1 else 2 end end as npred from a4),
a6 as (select *, list_slice(list_filter(spred, lambda c: not list_contains(list_transform(sel, lambda s: s.col), c.col_idx)), 1, npred) as pcols from a5),
st as (select *, list_transform(pcols, lambda c: {{'col': c.col_idx, 'col_name': c.col_name, 'op': {_OP},
    'val': case when {_OP} = 'between' then {_LOW} when {_OP} <> '=' then {_ONE} end,
    'val_2': case when {_OP} = 'between' then {_HIGH} end}}) as wh0 from a6),
en as (select table_id, attempt, unnest(list_filter(wh0, lambda c: c.op = '=')) as c from st),
em as (select table_id, attempt, count(*) as need from en group by all),
er as (select en.table_id, en.attempt, row_idx from en join pr on pr.table_id = en.table_id and pr.col_idx = en.c.col
  join em on em.table_id = en.table_id and em.attempt = en.attempt
  where trim(coalesce(value, '')) <> '' group by en.table_id, en.attempt, row_idx, need having count(*) = need),
ep as (select * from er qualify row_number() over (partition by table_id, attempt
  order by md5('7|' || table_id || '#' || attempt || '|' || row_idx), row_idx) = 1),
ev as (select ep.table_id, ep.attempt, ep.row_idx, map(list(cells.col_idx), list(trim(value))) as v
  from ep join cells using (table_id, row_idx) group by all),
gq as (select st.*, ev.row_idx, case when len(list_filter(wh0, lambda c: c.op = '=')) = 0 then wh0
    when ev.v is null then list_slice(wh0, 1, 0)
    else list_transform(wh0, lambda c: {{'col': c.col, 'col_name': c.col_name, 'op': c.op, 'val': case when c.op = '=' then ev.v[c.col] else c.val end, 'val_2': c.val_2}}) end as wh
  from st left join ev using (table_id, attempt))"""


def prompt_columns(spark, sf, types, prompt_rows):
    """Columns that may stand in a question: not those of very long cells, and of a wide table its first and some others."""
    named = PR.sample_columns(lake_columns(spark, sf).join(PR.oversized_columns(prompt_rows), PR.COLUMN, "left_anti"))
    return named.join(types, PR.COLUMN).join(PR.numeric_ranges(lake_rows(spark, sf)), PR.COLUMN, "left").select(
        *PR.COLUMN, "col_name", F.col("infer_type").isin("INT", "FLOAT").alias("numeric"), "lo", "hi", "all_int"
    )


def prompt_cells(spark, sf):
    return materialize(PR.sampled_cells(lake_rows(spark, sf), PROMPT_ROWS), "prompt-rows")


def structures(spark, sf, prompt_rows=None):
    """Types and equality values come from the sampled prompt rows of each table."""
    prompt_rows = prompt_cells(spark, sf) if prompt_rows is None else prompt_rows
    columns = prompt_columns(spark, sf, PR.infer_types(prompt_rows), prompt_rows)
    return BG.fill_equalities(BG.sample_structures(columns), prompt_rows)


@query("gen_12", f"""with {STRUCT_SQL}
select table_id, attempt, array_to_string(list_transform(sel, lambda s: coalesce(s.aggr, '-') || ' ' || s.col_name), ';') as sel,
  array_to_string(list_transform(wh, lambda c: c.col_name || ' ' || c.op || ' ' || coalesce(c.val, '-') || ' ' || coalesce(c.val_2, '-')), ';') as conditions,
  g.col_name as group_by, case when has then op1 || ' ' || {choice_sql(BG.HAVING_PREDICATES, 'hop')} end as having,
  o.col_name || ' ' || case when {u_sql('dir')} < 0.5 then 'desc' else 'asc' end as order_by,
  case when o is not null then {choice_sql(BG.TOPS, 'top')} end as top,
  ({u_sql('title')} < 0.9 / len(list_distinct(list_concat(list_transform(sel, lambda s: s.col), list_transform(wh, lambda c: c.col)))))::int as use_title
from gq""")
def sampled_structures(spark, sf):
    s = F.col("sql_struct")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return structures(spark, sf).select(
        "table_id", "attempt",
        F.array_join(F.transform(s["select"], lambda c: F.concat(dash(c["aggr"]), F.lit(" "), c["col_name"])), ";").alias("sel"),
        F.array_join(F.transform(s["where"], lambda c: F.concat_ws(" ", c["col_name"], c["op"], dash(c["val"]), dash(c["val_2"]))), ";").alias("conditions"),
        s["group_by"]["col_name"].alias("group_by"),
        F.concat(s["having"]["aggr"], F.lit(" "), s["having"]["pred_op"]).alias("having"),
        F.concat(s["order_by"]["col_name"], F.lit(" "), s["order_by"]["direction"]).alias("order_by"),
        s["limit"]["top"].alias("top"), BG.use_title(s, F.col("table_id")).alias("use_title"),
    )


def _compare(left, op, val, val_2):
    return f"case when {op} = 'between' then {left} || ' between `' || {val} || '` and `' || {val_2} || '`' else {left} || ' ' || {op} || ' `' || {val} || '`' end"


_HOP = choice_sql(BG.HAVING_PREDICATES, "hop")
_HAVING = _compare("""op1 || '("' || a1.col_name || '")'""", f"({_HOP})", f"(case when {_HOP} = 'between' then {_HL} else {_H1} end)", f"({_HH})")


@query("gen_13", f"""with {STRUCT_SQL}
select table_id, attempt, concat_ws(' ',
  'select ' || array_to_string(list_transform(sel, lambda s: case when s.aggr is null then '"' || s.col_name || '"' else s.aggr || '("' || s.col_name || '")' end), ', '),
  case when len(wh) > 0 then 'where ' || array_to_string(list_transform(wh, lambda c: {_compare("""'"' || c.col_name || '"'""", 'c.op', 'c.val', 'c.val_2')}), ' and ') end,
  'group by "' || g.col_name || '"', case when has then 'having ' || {_HAVING} end,
  'order by "' || o.col_name || '" ' || case when {u_sql('dir')} < 0.5 then 'desc' else 'asc' end,
  'limit ' || case when o is not null then {choice_sql(BG.TOPS, 'top')} end) as sql,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(sel, lambda s: s.col_name), list_transform(wh, lambda c: c.col_name),
    list_filter([g.col_name, case when has then a1.col_name end, o.col_name], lambda x: x is not null)))), '|') as ref_col_names,
  coalesce((select string_agg(distinct lower(trim(u.c.val)), '|' order by lower(trim(u.c.val))) from (select unnest(gq.wh) as c) u
    where exists (select 1 from ty where ty.table_id = gq.table_id and ty.col_idx = u.c.col and ty.infer_type = 'Other')), '') as ref_values from gq""")
def rendered(spark, sf):
    prompt_rows = prompt_cells(spark, sf)
    made = materialize(structures(spark, sf, prompt_rows), "structures")
    refs = BG.struct_references(made, PR.infer_types(prompt_rows)).select(
        "table_id", "attempt", *[F.array_join(c, "|").alias(c) for c in ("ref_col_names", "ref_values")]
    )
    return made.select("table_id", "attempt", BG.struct_text(F.col("sql_struct")).alias("sql")).join(refs, ["table_id", "attempt"])


@query("gen_14", f"""with {COLUMNS_SQL},
k as (select table_id, row_idx, row_number() over (partition by table_id order by md5('0|' || table_id || '|' || row_idx), row_idx) as no
  from cells where col_idx = 0 qualify no <= 10),
l as (select table_id, no, string_agg(value, ' | ' order by col_idx) as line from cells join k using (table_id, row_idx) group by all),
b as (select table_id, string_agg(line, chr(10) order by no) as body from l group by all),
h as (select table_id, string_agg(col_name, ' | ' order by col_idx) as header from cols group by all)
select table_id, 'Table Caption:' || chr(10) || 'Table ' || table_id || chr(10) || 'Table Data:' || chr(10) || header || chr(10) || body as prompt
from h join b using (table_id)""")
def table_prompts(spark, sf):
    captions = lake_columns(spark, sf).select("table_id").distinct().withColumn("caption", F.concat(F.lit("Table "), "table_id"))
    return BG.table_prompts(lake_rows(spark, sf), lake_columns(spark, sf), captions)


# ---- contexts and questions --------------------------------------------------------------------

ASKED = ["Who created the dataset?", "How often is it updated?", "What does a row stand for?"]
_ASKED_SQL = ", ".join(f"('{q}', {i})" for i, q in enumerate(ASKED))


@query("gen_21", f"""select doc_id || '_SEP_contexts-' || no as id, 'Answer ' || length(q) || ' for ' || n_chars as context,
  md5('Given a dataset, consisting of ' || n_chars || ' rows, with the following columns:' || chr(10) || '/*' || chr(10) || 'col: text | lang | ' || source
  || chr(10) || '*/' || chr(10) || 'and this question:' || chr(10) || '/*' || chr(10) || q || chr(10) || '*/' || chr(10)
  || 'Assume you are the creator of the table and have all the necessary information to respond to the question. Generate a concise answer to the question based on the table, satisfying the following criteria:'
  || chr(10) || '1. Completeness: The answer must definitively and comprehensively address all parts of the question.' || chr(10)
  || '2. Relevance: The answer must directly provide the information requested in the question without any extraneous details.') as digest
from documents, (values {_ASKED_SQL}) v(q, no) where doc_id not in (select doc_id from labels)""")
def contexts(spark, sf):
    """Every document is a table; labelled ones have their contexts already."""
    tables = table(spark, sf, "documents", "doc_id", "source", "n_chars").select(
        F.col("doc_id").cast("string").alias("table_id"), F.concat(F.lit("col: text | lang | "), "source").alias("schema_text"),
        F.col("n_chars").alias("n_rows"),
    )
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("table_id"))
    tasks = BG.context_tasks(tables, ASKED, done).withColumn(
        "prompt", BG.context_prompt(F.col("schema_text"), F.col("context_question"), F.col("n_rows"))
    )

    def model():
        import re

        def answer(prompts):
            found = [re.search(r"consisting of (\d+) rows.*this question:\n/\*\n(.*?)\n\*/", p, re.S) for p in prompts]
            return [f"Answer {len(m.group(2))} for {m.group(1)}" for m in found]

        return answer

    return D.generate(tasks, "prompt", "context", model).select("id", "context", F.md5("prompt").alias("digest"))


def messages(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "role", "text", by="conv_id").withColumn(
        "id", F.col("conv_id") * 1000 + F.col("turn")
    )


_STRATA_SQL = """g as (select count(distinct turn) as n from conversations),
sp as (select conv_id * 1000 + turn as id, turn, text, row_number() over (partition by turn order by md5('0|' || turn || '|' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) as sample_no
  from conversations qualify sample_no <= (select 1020 // n from g))"""


@query("gen_22", f"with {_STRATA_SQL} select id, turn, sample_no from sp")
def stratified(spark, sf):
    """The turn of a message stands for the question that elicited it."""
    return BG.stratified_sample(messages(spark, sf).select("id", "turn"), "turn", "id").select("id", "turn", "sample_no")


@query("gen_23", f"""with {_STRATA_SQL},
q as (select id as question_id, turn, list_distinct({terms_sql('text')}) as t from sp),
c as (select conv_id, turn, list_distinct({terms_sql('text')}) as t from conversations)
select distinct q.question_id, c.conv_id::varchar as table_id from q join c using (turn)
where len(list_intersect(q.t, c.t)) >= greatest(1, len(q.t) * 0.5)""")
def label_spreading(spark, sf):
    said = messages(spark, sf).select("id", "conv_id", "turn", tx.index_terms(F.col("text")).alias("terms"))
    picked = BG.stratified_sample(said.select("id", "turn"), "turn", "id").select("id")
    questions = said.join(picked, "id").select(F.col("id").alias("question_id"), F.col("turn").alias("elicitation"), "terms")
    contexts_ = said.select(
        F.col("id").alias("context_id"), F.col("conv_id").cast("string").alias("table_id"), F.col("turn").alias("elicitation"), "terms"
    )
    return BG.spread_labels(questions, contexts_)


@query("gen_24", """
select conv_id, turn, case turn % 3 when 0 then ' ' || replace(text, chr(10), ' ') || '?' when 1 then replace(text, chr(10), ' ') || '!' else text end as question from conversations""")
def rephrase_extraction(spark, sf):
    """Answers in three formats: numbered on the third line, marked, and bare."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    answer = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure.\n\nRephrased Question 1: "), flat, F.lit("?\n\nRephrased Question 2: no")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Rephrased Question: "), flat, F.lit("!"))).otherwise(F.col("text"))
    )
    return messages(spark, sf).select("conv_id", "turn", BG.rephrased(answer).alias("question"))


@query("gen_25", "select item_id, text as question from benchmark")
def rephrase_pass(spark, sf):
    asked = table(spark, sf, "benchmark").withColumn("prompt", BG.rephrase_prompt(F.col("text"), far=True))
    answered = D.generate(asked, "prompt", "answer", lambda: BG.echo_rephraser)
    return answered.select("item_id", BG.rephrased(F.col("answer")).alias("question"))


_NORM = lambda c: f"lower(trim(coalesce({c}, '')))"
_HVAL = f"case when ({_HOP}) = 'between' then {_HL} else {_H1} end"
_HTEXT = f"a1.col_name || '#' || op1 || '#' || ({_HOP}) || '#' || ({_HVAL}) || {{}} || '#' || coalesce(case when ({_HOP}) = 'between' then {_HH} end, '')"


def _cond_text(c: str, more: str = "''") -> str:
    return f"{_NORM(c + '.col_name')} || '#' || {_NORM(c + '.op')} || '#' || {_NORM(f'{c}.val || {more}')} || '#' || {_NORM(c + '.val_2')}"


@query("gen_26", f"""with {STRUCT_SQL},
kd as (select *, attempt % 5 as kind, attempt >= 5 and attempt % 5 = 0 as titled, {u_sql('dir')} < 0.5 as down, {choice_sql(BG.TOPS, 'top')} as tops from gq),
tx as (select table_id, attempt, titled,
  list_sort(list_transform(sel, lambda s: {_NORM('s.col_name')} || '#' || {_NORM('s.aggr')})) as ms,
  list_sort(list_transform(generate_series(1, len(sel)), lambda i: {_NORM("upper(sel[i].col_name) || ' '")} || '#'
    || {_NORM("coalesce(sel[i].aggr, '') || case when kind = 4 and o is null and i = 1 then 'x' else '' end")})) as bs,
  list_sort(list_transform(wh, lambda c: {_cond_text('c')})) as mw,
  list_sort(list_concat(list_transform(generate_series(1, len(wh)), lambda i: {_cond_text('wh[i]', "case when kind = 1 and i = 1 then 'x' else '' end")}),
    case when titled then ['zone#=#x#'] else [] end)) as bw,
  list_transform(wh, lambda c: {_NORM('c.col_name')}) as mn,
  g.col_name as mg, lower(trim(upper(g.col_name) || ' ')) as bg,
  case when has then {_HTEXT.format("''")} end as mh, case when has then {_HTEXT.format("case when kind = 2 then '9' else '' end")} end as bh,
  case when o is not null then o.col_name || '#' || down end as mo, case when o is not null then o.col_name || '#' || (case when kind = 3 then not down else down end) end as bo,
  case when o is not null then tops end as ml, case when o is not null then case when kind = 4 then tops + 1 else tops end end as bl from kd),
cp as (select table_id, attempt, ms = bs as same_select,
  case when titled then len(mw) < len(bw) and mw = list_filter(bw, lambda c: list_contains(mn, split_part(c, '#', 1))) else mw = bw end as same_where,
  mg is not distinct from bg as same_group_by, mh is not distinct from bh as same_having, mo is not distinct from bo as same_order_by, ml is not distinct from bl as same_limit,
  case when titled and len(mw) < len(bw) and mw = list_filter(bw, lambda c: list_contains(mn, split_part(c, '#', 1)))
    then array_to_string(list_transform(list_filter(bw, lambda c: not list_contains(mn, split_part(c, '#', 1))), lambda c: split_part(c, '#', 1)), ',') end as more_cols from tx)
select *, same_select and same_where and same_group_by and same_having and same_order_by and same_limit as consistent,
  array_to_string(list_filter([case when not same_select then 'select' end, case when not same_where then 'where' end, case when not same_group_by then 'group_by' end,
    case when not same_having then 'having' end, case when not same_order_by then 'order_by' end, case when not same_limit then 'limit' end], lambda x: x is not null), ',') as differences from cp""")
def structure_consistency(spark, sf):
    """Sampled structures read back in another order and notation, with another value, having value, direction, limit or
    aggregate, or with the condition that a title adds."""
    s, kind = F.col("sql_struct"), F.col("attempt") % 5
    told = structures(spark, sf).withColumn("sql_struct", s.withField("use_title", ((kind == 0) & (F.col("attempt") >= 5)).cast("int")))
    name = lambda c: F.concat(F.upper(c["col_name"]), F.lit(" "))
    ordered = s["order_by"].isNotNull()
    conds = F.transform(s["where"], lambda c, i: c.withField("col_name", name(c)).withField(
        "val", F.when((kind == 1) & (i == 0), F.concat(c["val"], F.lit("x"))).otherwise(c["val"])
    ))
    zone = F.struct(*[v.alias(f) for f, v in (
        ("col", F.lit(-1)), ("col_name", F.lit("Zone")), ("op", F.lit("=")), ("val", F.lit("x")), ("val_2", F.lit(None).cast("string")), ("row", F.lit(None).cast("bigint"))
    )])
    back = (
        s.withField("select", F.reverse(F.transform(s["select"], lambda c, i: c.withField("col_name", name(c)).withField(
            "aggr", F.when((kind == 4) & ~ordered & (i == 0), F.concat(F.coalesce(c["aggr"], F.lit("")), F.lit("x"))).otherwise(c["aggr"])
        ))))
        .withField("where", F.when(s["use_title"] == 1, F.concat(F.array(zone), F.reverse(conds))).otherwise(F.reverse(conds)))
        .withField("group_by", F.when(s["group_by"].isNotNull(), s["group_by"].withField("col_name", name(s["group_by"]))))
        .withField("having", F.when(s["having"].isNotNull(), s["having"].withField(
            "val", F.when(kind == 2, F.concat(s["having"]["val"], F.lit("9"))).otherwise(s["having"]["val"])
        )))
        .withField("order_by", F.when(ordered, s["order_by"].withField("direction", F.when(
            kind == 3, F.when(s["order_by"]["direction"] == "desc", "asc").otherwise("desc")
        ).otherwise(s["order_by"]["direction"]))))
        .withField("limit", F.when(ordered, s["limit"].withField("top", F.when(kind == 4, s["limit"]["top"] + 1).otherwise(s["limit"]["top"]))))
    )
    checked = BG.compare_structures(told.withColumn("back_struct", back))
    return checked.select(
        "table_id", "attempt", "same_select", "same_where", "same_group_by", "same_having", "same_order_by", "same_limit", "consistent",
        F.array_join("more_cols", ",").alias("more_cols"), F.array_join("differences", ",").alias("differences"),
    )


_W = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"


@query("gen_27", f"""
with w as (select doc_id, {_W} as w from documents),
n as (select doc_id, array_to_string(w, ' ') as q, list_filter([w[3], w[1], 'zz'], lambda c: c is not null) as cols, list_filter([array_to_string(list_slice(w, 4, 6), ' '), w[8]], lambda c: c is not null) as vals, len(w) as n from w)
select doc_id,
  array_to_string(list_filter(cols, lambda c: instr(q, c) > 1 and substr(q, instr(q, c) - 1, 1) in (' ', '(') and substr(q, instr(q, c) + length(c), 1) in (' ', ')')), '|') as copied_cols,
  array_to_string(list_filter(vals, lambda c: len(string_split(c, ' ')) >= 3 and instr(q, c) > 1 and substr(q, instr(q, c) - 1, 1) in (' ', '(') and substr(q, instr(q, c) + length(c), 1) in (' ', ')')), '|') as copied_cells from n""")
def copied_text(spark, sf):
    """Names and values are words of the document itself, which therefore stand in the question."""
    docs = table(spark, sf, "documents", "doc_id", "text", by="doc_id")
    w = tx.split_ws(F.lower("text"))
    at = lambda i: F.get(w, F.lit(i))
    asked = docs.select(
        "doc_id", F.col("text").alias("question"),
        F.array_compact(F.array(at(2), at(0), F.lit("zz"))).alias("ref_col_names"),
        F.array_compact(F.array(F.array_join(F.slice(w, 4, 3), " "), at(7))).alias("ref_values"),
    )
    out = BG.copied_texts(asked)
    return out.select(
        "doc_id", F.array_join("copied_cols", "|").alias("copied_cols"), F.array_join("copied_cells", "|").alias("copied_cells")
    )


@query("gen_28", f"""
with l as (select conv_id, turn, role, (generate_subscripts(p, 1) - 1)::int as no, unnest(p) as line from (select *, string_split(text, chr(10)) as p from conversations))
select conv_id, turn, 'question' as kind, no, {strip_sql('line')} as text from l
union all select conv_id, turn, 'sql', no + 1, {strip_sql('line')} from l
union all select conv_id, turn, 'entity', 0, role from conversations""")
def tagged_responses(spark, sf):
    """Model responses built from the lines of a message in the three tagged formats."""
    lines = F.split("text", "\n")
    number = lambda i: (i + 1).cast("string")
    questions = F.array_join(F.transform(lines, lambda x, i: F.concat(number(i), F.lit(". Translated_Begin: "), x)), "\n")
    sqls = F.array_join(F.transform(lines, lambda x, i: F.concat(
        F.lit("SQL_START_"), number(i), F.lit(" "), x, F.lit(" SQL_SEP_"), number(i))), "\n")
    ner = F.concat(F.lit("Text_1_NER_BEGIN\n1 || "), "role", F.lit(" || Person\nnoise\nText_1_NER_END"))
    m = messages(spark, sf).select("conv_id", "turn", questions.alias("q"), sqls.alias("s"), ner.alias("n"))
    parts = [
        ("question", BG.tagged_lines(F.col("q"), "Translated_Begin:")),
        ("sql", BG.bracketed(F.col("s"), "SQL_START_", "SQL_SEP_")),
        ("entity", F.transform(BG.entities(F.col("n")), lambda e, i: F.struct(i.alias("no"), e.alias("text")))),
    ]
    out = [m.select("conv_id", "turn", F.lit(k).alias("kind"), F.explode(c).alias("x")).select("conv_id", "turn", "kind", "x.no", "x.text") for k, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("gen_29", """
with s as (select doc_id, source, doc_id % 2 = 0 as even from documents)
select doc_id::varchar as question, source as table_id, 0 as row_idx from s where even
union all select doc_id::varchar, source, 5 from s where even
union all select doc_id::varchar, 'src' || (doc_id % 20), null from s where even
union all select doc_id::varchar, source, 3 from s where not even
union all select doc_id::varchar, 'src' || (doc_id % 20), 1 from s where not even
union all select doc_id::varchar, 'src' || (doc_id % 20), 2 from s where not even""")
def human_labels(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source")
    rows = F.when(F.col("doc_id") % 2 == 0, F.lit("2,7\nok")).otherwise(F.lit("5\n3, 4"))
    sheet = docs.select(
        F.concat("source", F.lit(" \nsrc"), (F.col("doc_id") % 20).cast("string")).alias("tables"),
        F.col("doc_id").cast("string").alias("question"), rows.alias("rows"),
    )
    return BG.label_rows(sheet)


@query("gen_30", """select source, doc_id, coalesce(toxic, 0) = 1 as is_label,
  row_number() over (partition by source order by coalesce(toxic, 0) desc, doc_id) as place from documents left join labels using (doc_id) qualify place <= 10""")
def row_cap(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    capped = BG.cap_rows(docs.select("source", "doc_id", "toxic"), "source", "doc_id", F.coalesce("toxic", F.lit(0)) == 1)
    return capped.select("source", "doc_id", "is_label", "place")


@query("gen_31", "select doc_id from documents where doc_id % 4 = 0 and text not like '% JOIN %' and text not like '% FROM %' and text not like '% WHERE %'")
def simple_queries(spark, sf):
    """Statements around document texts: simple, joined, nested and without a condition."""
    source, text = F.col("source"), F.col("text")
    kind = F.col("doc_id") % 4
    sql = (
        F.when(kind == 0, F.concat(F.lit("SELECT a FROM "), source, F.lit(" WHERE b = '"), text, F.lit("'")))
        .when(kind == 1, F.concat(F.lit("SELECT a FROM "), source, F.lit(" JOIN t ON x WHERE b = '"), text, F.lit("'")))
        .when(kind == 2, F.concat(F.lit("SELECT a FROM "), source, F.lit(" WHERE b IN (SELECT c FROM d WHERE e = '"), text, F.lit("')")))
        .otherwise(F.concat(F.lit("SELECT '"), text, F.lit("' FROM "), source))
    )
    return table(spark, sf, "documents", "doc_id", "source", "text").where(BG.is_simple(sql)).select("doc_id")


@query("gen_33", "select doc_id as id, text as question from documents")
def annotation_reset(spark, sf):
    annotated = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.array("source").alias("answer_tables"),
        F.lit(1).alias("filter_by_title"), F.lit(0).alias("filter_by_cell"),
    )
    return BG.reset_annotations(annotated)


def letters_sql(n: str) -> str:
    return (
        f"case when {n} <= 26 then chr((64 + {n})::int) when {n} <= 702 then chr((64 + ({n} - 1) // 26)::int) || chr((65 + ({n} - 1) % 26)::int) "
        f"else chr((64 + ({n} - 703) // 676 + 1)::int) || chr((65 + (({n} - 703) // 26) % 26)::int) || chr((65 + ({n} - 1) % 26)::int) end"
    )


@query("gen_34", f"""select c_custkey as id, 'customer' as table_id, c_mktsegment as title, c_name as question,
  c_custkey as answer_row, c_custkey + 2 as answer_row_grid, c_custkey % 800 as answer_col, {letters_sql('(c_custkey % 800 + 1)')} as answer_col_grid,
  (c_custkey % 30) || ' , ' || (c_custkey % 703) as where_cols,
  {letters_sql('(c_custkey % 30 + 1)')} || ' , ' || {letters_sql('(c_custkey % 703 + 1)')} as where_cols_grid from customer""")
def review_sheet(spark, sf):
    key = F.col("c_custkey")
    questions = table(spark, sf, "customer").select(
        key.alias("id"), F.lit("customer").alias("table_id"), F.col("c_mktsegment").alias("title"),
        F.concat(F.lit("| "), "c_name").alias("question"), key.alias("row"), (key % 800).alias("sel_col"),
        F.array(key % 30, key % 703).alias("where_cols"),
    )
    return BG.review_sheet(questions)


@query("gen_36", """
with e as (select doc_id, unnest(list_distinct([lang, source])) as e from documents),
p as (select doc_id, e from e qualify row_number() over (partition by doc_id order by md5('0|' || doc_id || '|' || e), e) = 1)
select doc_id, e as sample_entity, '1. select "a" , where context : { name : null , operator : like , value : ' || e || ' }' as sql_prompt from p""")
def title_entities(spark, sf):
    """The entity list comes back in the tagged format and is read from there."""
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    response = F.concat(
        F.lit("Text_1_NER_BEGIN\n1 || "), "lang", F.lit(" || Language\n2 || "), "source", F.lit(" || Facility\nText_1_NER_END")
    )
    asked = docs.select("doc_id", BG.entities(response).alias("entities"), F.lit('1. select "a"').alias("sql_prompt"))
    return BG.add_title_entity(asked, key="doc_id").select("doc_id", "sample_entity", "sql_prompt")
