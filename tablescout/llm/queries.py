"""The registered queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; installed on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    from tablescout.llm.token_counts import token_counts

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts(docs, path or vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the rows not held out."""
    from tablescout.llm.language_id import identify, train

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(fold != 2))
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")


@query("op7_sentence_pieces")
def op7_sentence_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_hash (Spark's xxhash64 of the id array), round_trip (decoding gives the text back)
    of every document."""
    from tablescout.llm.sentence_pieces import encode_pieces

    path = path or vocabulary("piece_bpe_32k.model")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    encoded = encode_pieces(docs, path, check="round_trip")
    return encoded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), "round_trip"
    )


@query("op9_two_pass_shuffle")
def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, read back from the
    written shards."""
    from tablescout.llm.common import utf8_bytes
    from tablescout.llm.two_pass_shuffle import two_pass_shuffle, write_shards

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = write_shards(two_pass_shuffle(docs, shards, utf8_bytes("text")))
    back = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    return back.select(
        "doc_id", (utf8_bytes("text") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SEARCH_K = 20
ASKED_EVERY = 20

_SEARCH_SQL = """
with usable as (
    select vec_id, min([{component} for x in embedding]) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 {more}
    group by vec_id
),
scored as (
    select q.vec_id as query_id, c.vec_id, {score} as score
    from usable q join usable c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 20
"""


@query("op6_vantage_points", _SEARCH_SQL.format(
    component="x::double", more="and len(list_filter(embedding, lambda x: x <> 0)) > 0", score="list_inner_product(q.v, c.v)"))
def op6_vantage_points(spark: SparkSession, sf_dir: str, relax: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: 20 nearest vectors by inner product for every 20th vector."""
    from tablescout.llm.vantage_points import RELAX, index_trees, vp_topk
    from tablescout.llm.vector_grid import finite

    v = F.col("embedding")
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)
    ).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("vector"))
    asked = rows.where(F.col("vec_id") % ASKED_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return vp_topk(asked, index_trees(rows), SEARCH_K, RELAX if relax is None else relax)


@query("op10_va_file", _SEARCH_SQL.format(
    component="floor(64 * x::double)::bigint", more="",
    score="coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]), 0)::bigint"))
def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the exact 20 largest integer inner products for every 20th vector."""
    from tablescout.llm.va_file import index_files, va_topk
    from tablescout.llm.vector_grid import finite

    v = F.col("embedding")
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & finite(v)
    ).select("vec_id", F.transform(v, lambda x: F.floor(F.lit(64) * x.cast("double"))).alias("vector"))
    asked = rows.where(F.col("vec_id") % ASKED_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return va_topk(asked, index_files(rows), SEARCH_K)


_WARC_SQL = """
with payloads as (
    select page_id, sha1(coalesce(html, '')) as h, strlen(coalesce(html, '')) as n from pages
),
kept as (select h, max(page_id) as keeper from payloads group by h)
select page_id, n::bigint as payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::integer >> (15 - 5 * (i % 4))) & 31) + 1, 1)
        for i in range(32)], '') as payload_digest,
    case when keeper is null or page_id = keeper then 'response' else 'revisit' end as record_type,
    case when keeper is null or page_id = keeper then null else keeper end as refers_to
from payloads join kept using (h)
"""


@query("op4_warc_bundles", _WARC_SQL)
def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    from tablescout.llm.warc_bundles import read_bundles, write_bundles

    bundles = write_bundles(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    from tablescout.llm.source_mix import mix

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


_JACCARD_SQL = r"""
with recursive lowered as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
),
shingled as materialized (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as s
    from lowered
),
sizes as materialized (select doc_id, count(*) as n from shingled group by doc_id),
shared as (
    select x.doc_id as a, y.doc_id as b, count(*) as common
    from shingled x join shingled y on x.s = y.s and x.doc_id <> y.doc_id group by all
),
links as materialized (
    select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * common >= 85 * (p.n + q.n - common)
),
reached(doc_id, seen) as (
    select doc_id, doc_id from documents
    union select links.b, reached.seen from reached join links on links.a = reached.doc_id
)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(seen) as component_id
from documents d left join sizes using (doc_id) join reached using (doc_id) group by d.doc_id
"""


@query("op8_ngram_join", _JACCARD_SQL)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 4-word shingles, Jaccard of at least 0.85."""
    from tablescout.llm.ngram_join import near_groups

    return near_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from tablescout.llm.html_extraction import extract, train

    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    steps = f"flatten([[ord(({text})[i]), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, len(({text})) + 1)])"
    step = "case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {steps}::bigint[]), lambda c, x: {step}), 4294967295)"


MERKLE_LEVELS = 16


def _merkle_sql() -> str:
    """Every level written out; 3^16 rows of one source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    cut = "replace(text, chr(10), '')"
    parts = [f"""d as materialized (
    select doc_id, source, {leaf('text')} as leaf,
      case when doc_id is not null and {crc32_sql('doc_id::varchar')} % 2 = 0 then {leaf(cut)} else {leaf('text')} end as given
    from documents),
r as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from d),
n as (select source, row_number() over (order by source nulls first) - 1 as tree from (select distinct source from d)),
a0 as materialized (select n.tree, r.place, r.leaf as h from r join n on r.source is not distinct from n.source)"""]
    for name, first in (("a", ""), ("b", f"b0 as materialized (select 0 as tree, tree as place, h from a{MERKLE_LEVELS})")):
        if first:
            parts.append(first)
        for i in range(MERKLE_LEVELS):
            low, run = f"{name}{i}", "partition by tree, place // 3 order by place"
            parts.append(f"""{name}{i + 1} as materialized (
    select tree, case when n = 1 then place else place // 3 end as place,
      case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by {low}w.place)) end as h
    from (select *, count(*) over (partition by tree) as n from {low}) {low}w group by tree, n, 2),
{name}s{i} as materialized (
    select tree, place, 
      case when n = 1 then '' else coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') end as p,
      case when n = 1 then '' else coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') end as q, n
    from (select *, count(*) over (partition by tree) as n from {low}))""")
    parts.append("f0 as (select doc_id, leaf, given as folded, '' as proof, n.tree, place, n.tree as t0, r.place as p0 "
                 "from r join n on r.source is not distinct from n.source)")
    at = 0
    for name in ("a", "b"):
        for i in range(MERKLE_LEVELS):
            on = "s.tree = f.tree and s.place = f.place" if name == "a" else "s.place = f.place"
            parts.append(f"""f{at + 1} as (select f.* replace (
      case when s.n > 1 then sha256(s.p || f.folded || s.q) else f.folded end as folded, f.proof || s.p || s.q as proof,
      case when s.n > 1 then f.place // 3 else f.place end as place)
    from f{at} f join {name}s{i} s on {on})""")
            at += 1
        if name == "a":
            parts.append(f"f{at + 1} as (select * replace (tree as place) from f{at})")
            at += 1
    return "with " + ",\n".join(parts) + f"""
select f.doc_id, f.leaf, s.h as subroot, b.h as root, sha256(f.proof) as proof_sha256, f.folded as folded_root,
  f.folded = b.h as verified
from f{at} f join a{MERKLE_LEVELS} s on s.tree = f.tree cross join b{MERKLE_LEVELS} b"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document. Texts of every second id
    (by crc32) lose their line breaks before they are held against the manifest."""
    from tablescout.llm.merkle_manifest import build_manifest, fold, leaf_digest, path_digest, proofs

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read_table(spark, sf_dir, "documents", *columns)
    leaf, cut = leaf_digest([F.col(c) for c in columns]), F.translate("text", "\n", "")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest([*map(F.col, columns[:-1]), cut]))
    manifest = build_manifest(docs, columns, "source", "doc_id", {"doc_id": F.col("doc_id"), "given": F.coalesce(tampered, leaf)})
    told = proofs(manifest).select(
        F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        path_digest(F.col("path")).alias("proof_sha256"), fold(F.col("row.given"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


_TRIE_SQL = f"""
with t as materialized (
    select *, row_number() over (partition by conv_id order by turn nulls first, dig) as pos
    from (select conv_id, turn, length(coalesce(text, '')) as cp,
            md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as dig
          from conversations where conv_id is not null)
),
c as materialized (
    select conv_id, max(pos) as own, conv_id - conv_id % 100 as base, ({crc32_sql('conv_id::varchar')} % 6)::bigint as h
    from t group by conv_id
),
hd as (select c.*, least(h, coalesce(b.own, 0)) as kept from c left join (select conv_id as id, own from c) b on b.id = c.base),
rb as (
    select hd.conv_id, t.pos as d, t.dig, t.cp from hd join t on t.conv_id = hd.base and t.pos <= hd.h
    union all
    select hd.conv_id, hd.kept + t.pos - hd.h, t.dig, t.cp from hd join t on t.conv_id = hd.conv_id and t.pos > hd.h
),
px as materialized (
    select conv_id, d, cp, md5(string_agg(dig, '') over (partition by conv_id order by d)) as k from rb
    union all select conv_id, 0, 0, 'root' from c
),
nodes as materialized (
    select k, any_value(d) as d, any_value(cp) as cp, count(*) as n_convs, min(conv_id) as conv_id from px group by k
),
up as (select n.k, p.k as parent from nodes n join px p on p.conv_id = n.conv_id and p.d = n.d - 1),
kids as (select parent as k, count(*) as n_children from up group by parent),
below as (
    select p.k, sum((v.n_convs - 1) * v.cp) as saved, count(*) filter (where kids.k is null) as n_leaves
    from nodes v join px p on p.conv_id = v.conv_id and p.d <= v.d left join kids on kids.k = v.k group by p.k
),
fin as (
    select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends
    from (select conv_id, k from px qualify d = max(d) over (partition by conv_id)) group by k
)
select n.conv_id, n.d::bigint as depth, pn.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::bigint as n_children,
    below.n_leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, coalesce(fin.ends, sha256('')) as ends_sha256
from nodes n join below using (k) left join kids using (k) left join fin using (k)
left join up on up.k = n.k left join nodes pn on pn.k = up.parent
"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Conversation c starts with the first crc32(c) % 6 turns of c - c % 100."""
    from tablescout.llm.prefix_trie import prefix_nodes, turn_paths, with_shared_heads

    talks = turn_paths(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    conv = F.col("conv_id")
    return prefix_nodes(with_shared_heads(talks, F.crc32(conv.cast("string")) % 6, conv - conv % 100, 5))


@query("op12_secret_spans")
def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of every document."""
    from tablescout.llm.secret_spans import ADDED, secret_spans, train

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_spans(docs, train(docs), ["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
