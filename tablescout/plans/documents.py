"""Document building and catalog queries (DOC, CAT)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablescout.functions import text as tx
from tablescout.operators import catalog as C
from tablescout.operators import documents as D
from tablescout.operators.packing import pack_blocks
from tablescout.plans.lake import COLUMNS_SQL, LAKE, lake_columns, plain
from tablescout.plans.registry import query, table

_CONCAT_SQL = "sc as (select table_id, string_agg(col_name, ' | ' order by col_idx) as schema_text from cols group by table_id)"
_PROMPT_SQL = """'A table has the following columns:' || chr(10) || '/*' || chr(10) || schema_text || chr(10) || '*/' || chr(10)
  || 'Describe briefly what the ' || col_name || ' column represents. If not possible, simply state "No description."'"""
_TOKENS_SQL = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda t: t <> ''))"


def pack_sql(pieces: str, group: str, separator: str, limit: int) -> str:
    """CTEs ending in bl(group, block, text, n_tokens, n_pieces); pieces has (group, o, text)."""
    return f"""
pc as (select {group} as g, row_number() over (partition by {group} order by o) as r, text,
              {_TOKENS_SQL.format('text')} as n from ({pieces})),
w as (select g, r, 0 as b, n from pc where r = 1
      union all
      select pc.g, pc.r, case when w.n + pc.n + 1 < {limit} then w.b else w.b + 1 end,
             case when w.n + pc.n + 1 < {limit} then w.n + pc.n + 1 else pc.n end
      from w join pc on pc.g = w.g and pc.r = w.r + 1),
bl as (select pc.g as {group}, w.b::bigint as block, string_agg(pc.text, '{separator}' order by pc.r) as text,
              (sum(pc.n) + count(*) - 1)::bigint as n_tokens, count(*) as n_pieces
       from pc join w on pc.g = w.g and pc.r = w.r group by all)"""


# ---- table -> documents ----------------------------------------------------------------------

@query("doc_01", f"with {COLUMNS_SQL} select table_id, col_idx, col_name from cols")
def schema_explode(spark, sf):
    return lake_columns(spark, sf)


@query("doc_02", f"with {COLUMNS_SQL}, {_CONCAT_SQL} select table_id, schema_text from sc")
def schema_text(spark, sf):
    return D.schema_concat(lake_columns(spark, sf))


@query("doc_03", f"with {COLUMNS_SQL}, {_CONCAT_SQL} select table_id, col_idx, {_PROMPT_SQL} as prompt from cols join sc using (table_id)")
def prompts(spark, sf):
    return D.narration_prompts(lake_columns(spark, sf)).select("table_id", "col_idx", "prompt")


@query("doc_04", f"with {COLUMNS_SQL} select table_id, col_idx, 'Values of ' || col_name || '.' as answer from cols")
def generated(spark, sf):
    return D.generate(D.narration_prompts(lake_columns(spark, sf)), "prompt", "answer").select(
        "table_id", "col_idx", "answer"
    )


@query("doc_05", f"""with {COLUMNS_SQL}
select table_id, string_agg(col_name || ': Values of ' || col_name || '.', chr(10) order by col_idx) as narrations
from cols group by table_id""")
def assembled(spark, sf):
    answers = D.generate(D.narration_prompts(lake_columns(spark, sf)), "prompt", "answer")
    return D.narrations_by_table(D.narrations(answers)).withColumn("narrations", F.array_join("narrations", "\n"))


_SAMPLE_SQL = """sm as (select source as table_id, doc_id, text,
  row_number() over (partition by source order by md5('0|' || doc_id), doc_id) as sample_no
  from documents qualify sample_no <= 5)"""


def sampled(spark, sf):
    docs = table(spark, sf, "documents", "source", "doc_id", "text", by="doc_id")
    keys = D.sample_rows(docs.select(F.col("source").alias("table_id"), "doc_id"), "table_id", "doc_id")
    return docs.join(keys, "doc_id").select("table_id", "doc_id", "sample_no", "text")


@query("doc_06", f"with {_SAMPLE_SQL} select table_id, doc_id, sample_no from sm")
def row_sample(spark, sf):
    rows = table(spark, sf, "documents", F.col("source").alias("table_id"), "doc_id")
    return D.sample_rows(rows, "table_id", "doc_id").select("table_id", "doc_id", "sample_no")


@query("doc_07", "select o_orderkey as row_idx, " + " || ' | ' || ".join(
    f"'{plain(c)}: ' || {c}::varchar" for c in LAKE["orders"][1]) + " as text from orders")
def row_serialised(spark, sf):
    df = table(spark, sf, "orders", *LAKE["orders"][1], by="o_orderkey")
    named = df.toDF(*[plain(c) for c in df.columns])
    return named.select(F.col("orderkey").alias("row_idx"), tx.row_text(named.columns).alias("text"))


@query("doc_08", f"""select doc_id, {_TOKENS_SQL.format('text')} as n_tokens,
  {_TOKENS_SQL.format('text')} < 512 as fits_local, {_TOKENS_SQL.format('text')} < 8191 as fits_hosted from documents""")
def token_counts(spark, sf):
    n = tx.token_count(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text", by="doc_id").select(
        "doc_id", n.alias("n_tokens"), (n < D.LOCAL_LIMIT).alias("fits_local"), (n < D.HOSTED_LIMIT).alias("fits_hosted")
    )


_BLOCK_OUT = "block, n_tokens, n_pieces, md5(text) as digest"


def block_out(df, group):
    return df.select(group, "block", "n_tokens", "n_pieces", F.md5("text").alias("digest"))


@query("doc_09", f"""with recursive {pack_sql('select source as table_id, doc_id as o, text from documents', 'table_id', ' || ', 512)}
select table_id, {_BLOCK_OUT} from bl""")
def packed(spark, sf):
    docs = table(spark, sf, "documents", F.col("source").alias("table_id"), "doc_id", "text", by="doc_id")
    return block_out(
        pack_blocks(docs, ["table_id"], "doc_id", "text", tx.token_count(F.col("text")), 512, " || "), "table_id"
    )


@query("doc_10", f"""with recursive {pack_sql('select conv_id::varchar as table_id, turn as o, text from conversations', 'table_id', ' | ', 128)}
select table_id, {_BLOCK_OUT} from bl""")
def merged_contexts(spark, sf):
    contexts = table(spark, sf, "conversations", "conv_id", "turn", "text", by="conv_id").select(
        F.col("conv_id").cast("string").alias("table_id"), "turn", "text"
    )
    return block_out(D.merge_contexts(contexts, order="turn", limit=128), "table_id")


@query("doc_11", f"""with recursive {pack_sql("select doc_id, unnest(generate_series(1, len(p))) as o, unnest(p) as text from (select doc_id, string_split(replace(text, chr(10), ' | '), ' | ') as p from documents)", 'doc_id', ' | ', 64)}
select doc_id, {_BLOCK_OUT}, doc_id::varchar || '_SEP_contents_SEP_schema' as sources from bl""")
def resplit(spark, sf):
    """The lines of a document stand for the columns of a joined schema summary."""
    summaries = table(spark, sf, "documents", "doc_id", "text", by="doc_id").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(" | ")).alias("summary")
    )
    blocks = D.resplit_schema(summaries, 64, "doc_id", "summary")
    return blocks.select(
        "doc_id", "block", "n_tokens", "n_pieces", F.md5("text").alias("digest"),
        F.array_join("source_ids", ",").alias("sources"),
    )


@query("doc_12", r"""select conv_id, turn,
  array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''), 1, 24), ' ') as prompt from conversations""")
def truncated(spark, sf):
    """A context of 40 tokens, a template of 12 and 4 new tokens leave 24."""
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", tx.cut_tokens(F.col("text"), 40 - 12 - 4).alias("prompt")
    )


@query("doc_13", """
with p as (select conv_id * 1000 + turn as id, length(text) as len from conversations),
r as (select id, len, row_number() over (order by len desc, id) - 1 as r, count(*) over () as n from p)
select id, len, case when r < ceil(n / 4) then r else (n - 1 - r) // 3 end::bigint as batch,
       case when r < ceil(n / 4) then 0 else (n - 1 - r) % 3 + 1 end::bigint as place from r""")
def batches(spark, sf):
    prompts = table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("len")
    )
    return D.balanced_batches(prompts, "id", "len", 4)


_KIND_SQL = "case doc_id % 3 when 0 then 'schema' when 1 then 'row' else 'context' end"
_CORPUS_SQL = f"""
pt as (select source as table_id, {_KIND_SQL} as kind, doc_id, text from documents),
nu as (select *, row_number() over (partition by table_id, kind order by doc_id) - 1 as ordinal from pt),
cp as (select table_id || case kind when 'schema' then '_SEP_contents_SEP_schema-' when 'row' then '_SEP_contents_SEP_row-'
         else '_SEP_contexts-' end || ordinal as doc_id, table_id, kind, ordinal, text from nu)"""


def corpus_parts(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "schema").when(F.col("doc_id") % 3 == 1, "row").otherwise("context")
    return table(spark, sf, "documents", F.col("source").alias("table_id"), "doc_id", "text", by="doc_id").withColumn(
        "kind", kind
    )


@query("doc_14", f"with {_CORPUS_SQL} select doc_id, table_id, kind, ordinal, md5(text) as digest from cp")
def corpus_assembly(spark, sf):
    return D.assemble_corpus(corpus_parts(spark, sf), "doc_id").select(
        "doc_id", "table_id", "kind", "ordinal", F.md5("text").alias("digest")
    )


@query("doc_15", """
with b as (select * from (values ('narrations','sample',true),('concat','all',false),('none','all',true)) v(schema_choice, row_choice, contexts)),
d as (select 'schema' as kind, 'narrations' as variant, count(*) as n from documents where doc_id % 3 = 0
  union all select 'schema', 'concat', count(*) from documents where doc_id % 3 = 1
  union all select 'row', 'all', count(*) from documents
  union all select 'row', 'sample', sum(least(5, c)) from (select count(*) as c from documents group by source)
  union all select 'context', 'contexts', count(*) from conversations)
select schema_choice, row_choice, contexts, kind, n::bigint as n_docs from b join d
  on (kind = 'schema' and variant = schema_choice) or (kind = 'row' and variant = row_choice) or (kind = 'context' and contexts)""")
def variants(spark, sf):
    docs = table(spark, sf, "documents", F.col("source").alias("table_id"), "doc_id")
    parts = {
        ("schema", "narrations"): docs.where("doc_id % 3 = 0"),
        ("schema", "concat"): docs.where("doc_id % 3 = 1"),
        ("row", "all"): docs,
        ("row", "sample"): D.sample_rows(docs, "table_id", "doc_id").drop("sample_no"),
        ("context", "contexts"): table(spark, sf, "conversations").select(
            F.col("conv_id").cast("string").alias("table_id"), F.col("turn").alias("doc_id")
        ),
    }
    out = []
    for schema, rows, contexts in [("narrations", "sample", True), ("concat", "all", False), ("none", "all", True)]:
        chosen = D.select_variant(parts, schema, rows, contexts)
        out.append(
            chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs")).select(
                F.lit(schema).alias("schema_choice"), F.lit(rows).alias("row_choice"),
                F.lit(contexts).alias("contexts"), "kind", "n_docs",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


@query("doc_16", f"""with {_CORPUS_SQL}
select doc_id, split_part(doc_id, '_SEP_', 1) as table_id,
  case when starts_with(split_part(doc_id, '_SEP_', 2), 'contents') then 'content' else 'context' end as kind from cp""")
def routing(spark, sf):
    ids = D.assemble_corpus(corpus_parts(spark, sf), "doc_id").select("doc_id")
    return ids.select(
        "doc_id", tx.table_of_doc(F.col("doc_id")).alias("table_id"), tx.kind_of_doc(F.col("doc_id")).alias("kind")
    )


@query("doc_17", "select kind, count(*) as n_docs from (select " + _KIND_SQL + " as kind from documents) group by kind")
def non_empty(spark, sf):
    return D.require_documents(corpus_parts(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- catalog ---------------------------------------------------------------------------------

@query("cat_01", """select 'table_status' as relation, count(distinct source) as n_rows from documents
  union all select r, 0 from (values ('table_contexts'),('table_summaries'),('indexes'),('index_table_mappings'),('query_history')) v(r)""")
def setup(spark, sf):
    """A fresh catalog after registering every source as a table."""
    relations = C.empty_relations(spark)
    hashes = C.table_fingerprint(table(spark, sf, "documents", "source", "doc_id"), "source", ["doc_id"])
    incoming = hashes.select(
        F.col("source").alias("id"), F.col("source").alias("table_name"), F.lit(C.REGISTERED).alias("status"),
        F.current_timestamp().alias("time_created"), F.lit("driver").alias("creator"), "hash",
    )
    relations["table_status"] = C.upsert(relations["table_status"], incoming)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")
        for name, df in relations.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


_ROW_DIGEST = "md5(" + " || '|' || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in ["doc_id", "lang", "text"]) + ")"


@query("cat_02", f"""
with d as (select source, {_ROW_DIGEST} as h from documents)
select source, md5(count(*) || '-' || {" || '-' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)" for i in range(4))}) as hash
from d group by source""")
def fingerprints(spark, sf):
    return C.table_fingerprint(table(spark, sf, "documents", "source", "doc_id", "lang", "text"), "source", ["doc_id", "lang", "text"])


@query("cat_03", """
with h as (select doc_id as id, md5(text) as hash from documents),
k as (select md5(text) as hash, min(item_id) as known from benchmark group by 1),
f as (select hash, min(id) as first from h group by hash)
select id, known is null and first = id as accepted,
  case when not (known is null and first = id) then coalesce(known, first) end as same_as
from h join f using (hash) left join k using (hash)""")
def duplicates(spark, sf):
    """Documents are incoming tables; the questions' texts are registered already."""
    incoming = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    known = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("hash"))
    return C.split_duplicates(incoming, known).select("id", "accepted", "same_as")


@query("cat_04", """
select doc_id as id, 'SUMMARIZED' as status, md5(text) as hash from documents where doc_id not in (select doc_id from labels)
union all select doc_id, 'REGISTERED', md5(quality || '|' || toxic) from labels""")
def upserted(spark, sf):
    old = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(C.SUMMARIZED).alias("status"), F.md5("text").alias("hash")
    )
    new = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.lit(C.REGISTERED).alias("status"),
        F.md5(F.concat_ws("|", "quality", "toxic")).alias("hash"),
    )
    return C.upsert(old, new)


@query("cat_05", r"""select page_id, replace(replace(replace(url, '/', '\'), '\', '/'), '"', '''''') as id,
  regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^.]*$', '') as table_name from pages""")
def identifiers(spark, sf):
    """URLs with backslashes stand for foreign paths."""
    path = F.replace("url", F.lit("/"), F.lit("\\"))
    return table(spark, sf, "pages", "page_id", "url").select(
        "page_id", C.normal_id(path).alias("id"), C.table_name(path).alias("table_name")
    )


_STATUS_SQL = """st as (select d.doc_id as id, case when quality = 1 then 'SUMMARIZED' when toxic = 1 then 'DELETED' else 'REGISTERED' end as status
  from documents d left join labels l using (doc_id))"""


def statuses(spark, sf):
    docs = table(spark, sf, "documents", "doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, C.SUMMARIZED).when(F.col("toxic") == 1, C.DELETED).otherwise(C.REGISTERED).alias("status"),
    )


@query("cat_06", f"with {_STATUS_SQL} select id, status from st where status = 'REGISTERED'")
def pending(spark, sf):
    return C.pending(statuses(spark, sf))


@query("cat_07", f"with {_STATUS_SQL} select vec_id as id from embeddings where vec_id not in (select id from st where status in ('SUMMARIZED', 'DELETED'))")
def guarded(spark, sf):
    """Summaries are wanted for every table with a vector."""
    return C.unsummarised(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), statuses(spark, sf))


@query("cat_08", f"with {_STATUS_SQL} select id, case when id in (select vec_id from embeddings) then 'SUMMARIZED' else status end as status from st")
def transitions(spark, sf):
    return C.mark(statuses(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("cat_09", """
select event_id::varchar as table_id, event_id in (select doc_id from documents) as accepted,
  case when event_id in (select doc_id from documents) then json_object('payload', trim(props))::varchar end as context,
  case when event_id not in (select doc_id from documents) then 'unknown table ' || event_id end as reason from events""")
def referenced(spark, sf):
    metadata = table(spark, sf, "events", "event_id", "props").select(
        F.col("event_id").cast("string").alias("table_id"), F.col("props").alias("value")
    )
    status = table(spark, sf, "documents", "doc_id").select(F.col("doc_id").cast("string").alias("id"))
    return C.check_references(metadata, status).drop("value")


@query("cat_10", """select event_id, (select max(doc_id) from documents) + row_number() over (order by event_id) as id from events""")
def surrogate_ids(spark, sf):
    last = table(spark, sf, "documents", "doc_id").agg(F.max("doc_id")).scalar()
    return C.assign_ids(table(spark, sf, "events", "event_id"), last, "event_id")


@query("cat_11", """select 'NATION_' || (c_custkey % 40) as name, min(c_custkey) as request from customer
  where 'NATION_' || (c_custkey % 40) not in (select n_name from nation) group by 1""")
def unique_names(spark, sf):
    requests = table(spark, sf, "customer", "c_custkey").select(
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("request")
    )
    return C.free_names(requests, table(spark, sf, "nation").select(F.col("n_name").alias("name")), "request")


@query("cat_12", "select index_id, table_id from (select distinct source as table_id from documents), (values (1::bigint), (2::bigint)) v(index_id)")
def mappings(spark, sf):
    return C.map_tables(table(spark, sf, "documents", F.col("source").alias("table_id")), [1, 2])


@query("cat_13", """
with h as (select doc_id, source, row_number() over (partition by md5(text) order by doc_id) = 1 as accepted from documents)
select source, count(*) as file_count, count(*) filter (not accepted) as failed,
  '{"status":"SUCCESS","message":"' || count(*) || ' files in folder ' || source || ' has been processed.","data":{"file_count":' || count(*) || '}}' as response
from h group by source""")
def outcome_report(spark, sf):
    incoming = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.md5("text").alias("hash"))
    outcomes = C.split_duplicates(incoming, incoming.limit(0).select("id", "hash"))
    return C.batch_report(outcomes, "source")
