"""Evaluation queries (EVA). A document's source stands for its table; a question's answer is the source of the document with its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import evaluate as E
from tablescout.operators import retrieve as R
from tablescout.plans import retrieval as P
from tablescout.plans.registry import query, table
from tablescout.session import scratch_path

KS, NS, ALPHAS = [1, 3, 5], [1, 3, 5], [0.1, 0.3, 0.5, 0.7, 0.9]
POINTS = E.grid(KS, NS, ALPHAS)

_VARIANT_SQL = """qv as (select item_id as question_id, unnest(['BC1', 'BC2', 'BX1', 'BX2']) as variant,
  unnest([text, 'Which table: ' || text, text || ' Where?', 'About: ' || text]) as question from benchmark)"""


def variants(spark, sf):
    b = table(spark, sf, "benchmark")
    wide = b.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question_from_sql_1"),
        F.concat(F.lit("Which table: "), "text").alias("question"), F.concat("text", F.lit(" Where?")).alias("question_bx1"),
        F.concat(F.lit("About: "), "text").alias("question_bx2"),
    )
    return E.question_variants(wide)


@query("eva_01", f"with {_VARIANT_SQL} select * from qv")
def variant_selection(spark, sf):
    return variants(spark, sf)


_LABELS_SQL = f"""{P.fused_sql()},
aw as (select item_id as query_id, source as table_id from benchmark join documents on item_id = doc_id),
tb as (select rk.query_id, docs.source as table_id, min(rk.rank) as doc_rank
       from rk join docs using (doc_id) where rk.rank <= {P.K} group by all),
ht as (select qs.query_id, max(case when aw.table_id is not null then 1 else 0 end) as hit
       from qs left join tb using (query_id) left join aw using (query_id, table_id) group by 1)"""


def hit_rows(spark, sf):
    sources = table(spark, sf, "documents", "doc_id", "source")
    tables = R.tables_of(P.few_ranked(spark, sf).join(sources, "doc_id"), P.K, F.col("source"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    answers = asked.join(sources, asked.query_id == sources.doc_id).select("query_id", F.col("source").alias("table_id"))
    return E.hits(tables, answers, asked, P.K)


@query("eva_02", f"with {_LABELS_SQL} select query_id, hit from ht")
def hit_at_k(spark, sf):
    return hit_rows(spark, sf)


@query("eva_03", f"""with {_LABELS_SQL}
select 'BC1' as variant, {P.K} as k, {P.N} as n, {P.ALPHA} as alpha, round(avg(hit) * 100, 2) as hitrate, sum(hit) as hits, count(*) as questions from ht""")
def hit_rate(spark, sf):
    named = hit_rows(spark, sf).withColumns(
        {"variant": F.lit("BC1"), "k": F.lit(P.K), "n": F.lit(P.N), "alpha": F.lit(P.ALPHA)}
    )
    return E.hit_rates(named, ["variant", "k", "n", "alpha"])


@query("eva_04", f"with {_LABELS_SQL} select query_id from ht where hit = 0")
def miss_list(spark, sf):
    return E.misses(hit_rows(spark, sf))


@query("eva_05", f"""with {P.hybrid_sql(E.grid_depth(POINTS))},
gp as (select * from (select unnest({KS}) as k), (select unnest({NS}) as n), (select unnest({ALPHAS})::double as alpha)),
gw as (select gp.*, co.* from gp join co on coalesce(text_rank, 999999) <= k * n or coalesce(vector_rank, 999999) <= k * n),
gn as (select *,
   case when max(text_score) over w = min(text_score) over w then 1.0
        else (text_score - min(text_score) over w) / (max(text_score) over w - min(text_score) over w) end as tn,
   case when max(vector_score) over w = min(vector_score) over w then 1.0
        else (vector_score - min(vector_score) over w) / (max(vector_score) over w - min(vector_score) over w) end as vn
   from gw window w as (partition by k, n, alpha, query_id)),
gr as (select *, row_number() over (partition by k, n, alpha, query_id order by round(alpha * tn + (1 - alpha) * vn, 6) desc, doc_id) as rank
       from gn qualify rank <= k),
gh as (select k, n, alpha, gr.query_id, max(case when d.source = q.source then 1 else 0 end) as hit
       from gr join documents d on d.doc_id = gr.doc_id left join documents q on q.doc_id = gr.query_id group by all)
select k, n, alpha, round(avg(hit) * 100, 2) as hitrate, sum(hit) as hits, count(*) as questions from gh group by all""")
def parameter_grid(spark, sf):
    pooled = R.pooled_candidates(*P.hybrid_inputs(spark, sf), E.grid_depth(POINTS))
    sources = table(spark, sf, "documents", "doc_id", "source")
    labelled = pooled.join(sources.withColumnRenamed("source", "d_source"), "doc_id").join(
        sources.select(F.col("doc_id").alias("query_id"), F.col("source").alias("q_source")), "query_id", "left"
    )
    return E.hit_rates(E.grid_hits(labelled, POINTS, F.coalesce(F.col("d_source") == F.col("q_source"), F.lit(False))), E.GRID_KEYS)


@query("eva_06", f"""with {P._CORPUS}, v as (
select query_id, doc_id, round(list_cosine_similarity(qv::double[], v::double[]), 2) as score,
  row_number() over (partition by query_id order by round(list_cosine_similarity(qv::double[], v::double[]), 6) desc, doc_id) as rank
from qs cross join docs qualify rank <= {P.DEPTH})
select query_id, doc_id, score, dense_rank() over (partition by query_id order by score desc) as tie_rank from v""")
def tie_aware_ranks(spark, sf):
    """Scores cut to two digits, so that ties occur."""
    ranked = P.vector_topk(spark, sf).withColumn("score", F.round("score", 2))
    return E.tie_ranks(ranked).select("query_id", "doc_id", "score", "tie_rank")


@query("eva_07", """select doc_id, case when contains(response, a || '.csv') or contains(response, b || '.csv') then 1 else 0 end as hit
from (select doc_id, 'The table ' || source || '.csv fits. ' || text as response, 'src' || (doc_id % 20) as a, 'src' || (doc_id % 7) as b from documents)""")
def answer_mentions(spark, sf):
    name = lambda m: F.concat(F.lit("src"), (F.col("doc_id") % m).cast("string"))
    responses = table(spark, sf, "documents", "doc_id", "source", "text").select(
        "doc_id", F.concat(F.lit("The table "), "source", F.lit(".csv fits. "), "text").alias("response"),
        F.array(name(20), name(7)).alias("answer_tables"),
    )
    return E.mention_hits(responses).select("doc_id", "hit")


@query("eva_08", """with e as (select event_type as phase, count(*) as n, sum(value) as s from events group by 1),
a as (select * from e union all select 'ALL', sum(n), sum(s) from e)
select phase, n, round(s, 4) as seconds, round(n / s, 6) as per_second from a""")
def throughput_report(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("phase"), "value")
    return E.throughput(runs, "phase", "value")


@query("eva_09", """select user_id, event_type, event_id, value,
  row_number() over (partition by user_id, event_type order by value, event_id) as run from events qualify run <= 10""")
def best_runs(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return E.best_runs(runs, "user_id", "event_type", "value", "event_id")


@query("eva_10", "select lang, doc_id, row_number() over (partition by lang order by doc_id) as q_no from documents qualify q_no <= 50")
def question_cap(spark, sf):
    return E.first_questions(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("eva_11", rf"""with {_VARIANT_SQL},
w as (select * from (select question_id, variant, unnest(regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}_]+')) as t from qv) where length(t) >= 2),
c as (select question_id, variant, (('0x' || substr(md5(t), 1, 8))::bigint % 64)::int as dim, count(*) as n from w group by all),
nn as (select question_id, variant, sqrt(sum(n * n)) as norm from c group by all)
select question_id, variant, dim, round(n / norm, 6) as value from c join nn using (question_id, variant)""")
def question_embeddings(spark, sf):
    stored = E.precompute_embeddings(variants(spark, sf), scratch_path(spark, "question-vectors"))
    return (
        stored.select("question_id", "variant", F.posexplode("vector").alias("dim", "value"))
        .where("value <> 0").withColumn("value", F.round("value", 6))
    )


@query("eva_12", """
with q as (select doc_id as id, doc_id % 3 as n_eq, list_distinct([source, lang]) as new, list_distinct([source, 'en']) as old from documents)
select id, array_to_string(list_sort(list_filter(new, lambda x: not list_contains(old, x))), ',') as added,
       array_to_string(list_sort(list_filter(old, lambda x: not list_contains(new, x))), ',') as removed
from q where n_eq <= 1 and (len(list_filter(new, lambda x: not list_contains(old, x))) > 0 or len(list_filter(old, lambda x: not list_contains(new, x))) > 0)""")
def annotation_diff(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "lang")
    eq = F.struct(F.lit("=").alias("op"))
    where = F.when(F.col("doc_id") % 3 == 0, F.slice(F.array(eq, eq), 1, 0)).when(F.col("doc_id") % 3 == 1, F.array(eq)).otherwise(F.array(eq, eq))
    new = docs.select(F.col("doc_id").alias("id"), where.alias("where"), F.array("source", "lang").alias("answer_tables"))
    old = docs.select(F.col("doc_id").alias("id"), F.array("source", F.lit("en")).alias("answer_tables"))
    diff = E.annotation_diff(new, old)
    return diff.select("id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))
