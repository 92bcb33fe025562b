"""Full-text relation: analysis, postings, term weights, and blocks of documents with bounds for top-k questions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescout.functions.stemming import stem_terms
from tablescout.functions.text import index_terms
from tablescout.operators.scaling import fits, salted_join
from tablescout.operators.topk import LOW, Best, answer_schema, as_ids, merged, millionths, question_blocks
from tablescout.session import materialize, text_batches

# Default constants of the ranking function.
K1 = 1.5
B = 0.75


def analyze(df: DataFrame, text: str = "text", stem: bool = True) -> DataFrame:
    """Adds `terms`: lower-case words without stop words, stemmed when asked."""
    text_batches(df.sparkSession)
    terms = index_terms(F.col(text))
    return df.withColumn("terms", stem_terms(terms) if stem else terms)


def _counted(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(places, codes, tfs, vocabulary) of a list column: how often each row has each of its terms, ordered by term."""
    flat = terms.flatten()
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    width = max(1, len(terms))
    key, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * width + row, return_counts=True)
    return key % width, key // width, tf, coded.dictionary.take(order)


def postings(analyzed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, dl, term, tf). A document's terms are counted where it lies; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, terms = batch.column(0), batch.column(1)
            place, code, tf, words = _counted(terms)
            at = pa.array(place)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), pc.list_value_length(terms).take(at), words.take(pa.array(code)), pa.array(tf)],
                [doc, "dl", "term", "tf"],
            )

    text_batches(analyzed.sparkSession)
    kind = analyzed.schema[doc].dataType.simpleString()
    return analyzed.select(doc, F.coalesce("terms", F.array().cast("array<string>")).alias("terms")).mapInArrow(run, f"{doc} {kind}, dl int, term string, tf long")


def term_totals(terms: DataFrame, n_docs: int) -> DataFrame:
    """One row: number of documents and their average length, from the term statistics alone."""
    return terms.agg(F.lit(n_docs).cast("long").alias("n_docs"), (F.coalesce(F.sum("ttf"), F.lit(0)) / F.lit(n_docs)).alias("avgdl"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, ttf): documents that have the term, and how often it stands in all of them."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def bm25_weight(tf, dl, df, n_docs, avgdl, k1: float = K1, b: float = B) -> Column:
    tf, dl, df = F.col(tf), F.col(dl), F.col(df)
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def weigh(
    post: DataFrame, terms: DataFrame, stats: DataFrame, doc: str = "doc_id", few_terms: bool | None = None
) -> DataFrame:
    """(doc, term, weight): postings joined with document frequencies.

    A vocabulary known or counted small is broadcast. Beyond that, frequent terms
    are salted so that no task holds all postings of one term."""
    if fits(terms) if few_terms is None else few_terms:
        joined = post.join(F.broadcast(terms.select("term", "df")), "term")
    else:
        joined = salted_join(post, terms.select("term", "df"), terms.select("term", F.col("df").alias("n")), ["term"], [doc])
    n_docs = stats.select("n_docs").scalar()
    avgdl = stats.select("avgdl").scalar()
    return joined.select(doc, "term", bm25_weight("tf", "dl", "df", n_docs, avgdl).alias("weight"))


def query_terms(queries: DataFrame, text: str = "query", stem: bool = True) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts as often as it is asked."""
    return (
        analyze(queries, text, stem)
        .select("query_id", F.explode("terms").alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


# ---- blocks of documents

BLOCK_DOCS = 2_048
QUESTION_TERMS = 50_000
SCORES = 1 << 20  # scores that are held at once
GONE_PLACES = 4_000_000  # places of deleted documents that go to every task at once
# A block is a row of a few MB, and Spark's reader and writer hold whole row groups (up to 4,096 and 100 rows): a row group a block.
BLOCK_FILES = {"parquet.block.row.count.limit": "1"}
BLOCKS = (
    "block string, doc_ids array<{id}>, lengths array<int>, terms array<string>, dfs array<int>, places array<int>, "
    "tfs array<int>, most array<int>, shortest array<int>"
)


def text_blocks(analyzed: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """An inverted file a row: up to BLOCK_DOCS documents that lie together, their terms in order, per term how many of
    them have it (dfs), which (places) and how often (tfs), its largest tf and its shortest document. The last two
    bound what the term can add to any score of the block, whatever the statistics of the corpus.

    Texts are read once and nothing is shuffled. `asked` keeps only these terms; lengths count all."""
    keep = None if asked is None else pa.array(sorted(asked), pa.string())
    schema = T._parse_datatype_string(BLOCKS.format(id=analyzed.schema["doc_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(a, BLOCK_DOCS)
                yield _block(part.column(0), part.column(1), keep)

    text_batches(analyzed.sparkSession)
    rows = analyzed.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return rows.mapInArrow(run, schema)


def _block(ids: pa.Array, terms: pa.Array, keep: pa.Array | None) -> pa.RecordBatch:
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int32)
    if keep is not None:
        flat = terms.flatten()
        wanted = pc.is_in(flat, keep).to_numpy(zero_copy_only=False)
        left = np.concatenate([[0], np.cumsum(wanted)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        terms = pa.ListArray.from_arrays(pa.array(left[ends].astype(np.int32)), flat.filter(pa.array(wanted)))
    place, code, tf, words = _counted(terms)
    starts = np.flatnonzero(np.append(True, np.diff(code) > 0)) if len(code) else np.zeros(0, int)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    shortest = np.minimum.reduceat(lengths[place], starts) if len(starts) else tf
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(lengths, pa.int32()),
         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), one(np.diff(np.append(starts, len(code))), pa.int32()), one(place, pa.int32()), one(tf, pa.int32()),
         one(most, pa.int32()), one(shortest, pa.int32())],
        ["block", "doc_ids", "lengths", "terms", "dfs", "places", "tfs", "most", "shortest"],
    )


def block_terms(blocks: DataFrame) -> DataFrame:
    """(term, df) over all blocks."""
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    return pairs.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))


def block_totals(blocks: DataFrame) -> DataFrame:
    """(n, len): documents and their terms."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    return blocks.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("len"))


def with_gone(blocks: DataFrame, dead: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with `gone`, the places of their deleted documents in dead(block, places). Places go to the blocks, which never
    move; beyond GONE_PLACES the blocks are read in parts, each with the places of its own."""
    parts = max(1, -(-(dead.agg(F.sum(F.size("places"))).first()[0] or 0) // GONE_PLACES))
    marks = dead.select("block", F.col("places").alias("gone"))
    part = lambda df, i: df if parts == 1 else df.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == i)
    return reduce(DataFrame.unionByName, [part(blocks, i).join(F.broadcast(part(marks, i)), "block", how) for i in range(parts)])


def lost_terms(blocks: DataFrame) -> DataFrame:
    """(term, df) of the documents at the places `gone` of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, dfs, places, gone = (batch.column(c)[i].values for c in ("terms", "dfs", "places", "gone"))
                if not len(terms):
                    continue
                dfs = dfs.to_numpy()
                n = np.add.reduceat(np.isin(places.to_numpy(), gone.to_numpy()), np.cumsum(dfs) - dfs, dtype=np.int64)
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([terms.take(some), pa.array(n).take(some)], ["term", "df"])

    text_batches(blocks.sparkSession)
    return blocks.select("terms", "dfs", "places", "gone").mapInArrow(run, "term string, df long")


@dataclass
class TextSource:
    """What full-text questions are asked of: blocks; (term, df) and (n, len), whose rows are added up (one of each per
    segment, negative ones for deletions); places of deleted documents by block, if there are any."""

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    dead: DataFrame | None = None

    def rows(self) -> DataFrame:
        if self.dead is None:
            return self.blocks.withColumn("gone", F.lit(None).cast("array<int>"))
        return with_gone(self.blocks, self.dead, "left")


def analyzed_source(analyzed: DataFrame, q_terms: DataFrame | None = None) -> TextSource:
    """A source straight from an analyzed corpus: its blocks are written once. With the questions known, and their words
    few enough for every task to hold, only asked words are kept."""
    asked = None
    if q_terms is not None:
        words = q_terms.select("term").distinct().limit(QUESTION_TERMS + 1).collect()
        asked = [r["term"] for r in words] if len(words) <= QUESTION_TERMS else None
    blocks = materialize(text_blocks(analyzed, asked), "text-blocks", **BLOCK_FILES)
    return TextSource(blocks, block_terms(blocks), block_totals(blocks))


@dataclass
class _Questions:
    """A block of questions: flat (term, question, qtf), and the idf of every asked term that the corpus has."""

    ids: list
    terms: list[str]
    term: np.ndarray
    question: np.ndarray
    qtf: np.ndarray
    idf: np.ndarray
    avgdl: float
    pairs: tuple | None = None

    def part(self, tf, dl):
        return tf / (tf + K1 * (1 - B + B * dl / self.avgdl))


def _read_questions(source: TextSource, rows: list) -> _Questions | None:
    """Statistics of one block's terms: a lookup of at most QUESTION_TERMS terms."""
    spark = source.blocks.sparkSession
    words = sorted({r["term"] for r in rows})
    asked = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string())}))
    known = source.terms.join(F.broadcast(asked), "term")
    # terms have a letter at least, so the two totals can come along under names of their own
    sums = source.totals.select(F.explode(F.create_map(F.lit(" n"), "n", F.lit(" len"), "len")).alias("term", "df"))
    seen = known.select("term", "df").unionByName(sums).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    dfs = {r["term"]: r["df"] for r in seen.collect()}
    n, length = dfs.pop(" n", 0), dfs.pop(" len", 0)
    words = [w for w in words if w in dfs]
    if not words or n <= 0 or length <= 0:
        return None
    df = np.array([dfs[w] for w in words], float)
    place, ids = {w: i for i, w in enumerate(words)}, sorted({r["query_id"] for r in rows})
    at = {q: i for i, q in enumerate(ids)}
    flat = sorted((place[r["term"]], at[r["query_id"]], r["qtf"]) for r in rows if r["term"] in place)
    term, question, qtf = (np.array(c) for c in zip(*flat))
    return _Questions(ids, words, term, question, qtf.astype(float), np.log(1 + (n - df + 0.5) / (df + 0.5)), length / n)


class _Block:
    """One block row with the places of the asked terms in it."""

    def __init__(self, row: pa.RecordBatch, i: int, asked: pa.Array):
        get = lambda name: row.column(name)[i].values
        self.ids, self.lengths = as_ids(get("doc_ids")), get("lengths").to_numpy()
        found = pc.index_in(asked, value_set=get("terms"))
        self.known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        self.at = found.drop_null().to_numpy()
        dfs = get("dfs").to_numpy()
        self.end = np.cumsum(dfs)
        self.start = self.end - dfs
        self.places, self.tfs, self.most, self.shortest = (get(c).to_numpy() for c in ("places", "tfs", "most", "shortest"))
        gone = row.column("gone")[i]
        self.gone = None if not gone.is_valid else gone.values.to_numpy()


def _block_map(shared, body, query_type: pa.DataType, id_type: pa.DataType, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Questions = shared.value
        terms = pa.array(asked.terms, pa.string())
        best = Best(len(asked.ids), k)
        for batch in batches:
            for i in range(batch.num_rows):
                yield from body(asked, _Block(batch, i, terms), best, query_type, id_type)
        yield from best.batch(asked.ids, query_type, id_type)

    return run


def _top_of_block(asked: _Questions, block: _Block, best: Best, *_) -> Iterator[pa.RecordBatch]:
    """Scores the block for the questions whose upper bound reaches their k-th answer so far."""
    bound = np.zeros(len(asked.terms))
    bound[block.known] = asked.idf[block.known] * asked.part(block.most[block.at].astype(float), block.shortest[block.at])
    upper = np.bincount(asked.question, asked.qtf * bound[asked.term], len(asked.ids))
    open_ = np.flatnonzero((upper > 0) & (millionths(upper) + 1 >= best.least))
    step = max(1, SCORES // max(1, len(block.ids)))
    for a in range(0, len(open_), step):
        _score_block(asked, block, best, open_[a : a + step])
    yield from ()


def _score_block(asked: _Questions, block: _Block, best: Best, open_: np.ndarray) -> None:
    """Scores the block for the questions `open_`."""
    slot = np.full(len(asked.ids), -1)
    slot[open_] = np.arange(len(open_))
    scores = np.zeros((len(open_), len(block.ids)))
    first = np.searchsorted(asked.term, np.arange(len(asked.terms) + 1))
    for t, at in zip(block.known.tolist(), block.at.tolist()):
        who = slice(first[t], first[t + 1])
        rows = slot[asked.question[who]]
        if (rows < 0).all():
            continue
        places, tf = block.places[block.start[at] : block.end[at]], block.tfs[block.start[at] : block.end[at]]
        weight = asked.idf[t] * asked.part(tf.astype(float), block.lengths[places])
        for r, qtf in zip(rows.tolist(), asked.qtf[who].tolist()):
            if r >= 0:
                scores[r, places] += qtf * weight
    if block.gone is not None:
        scores[:, block.gone] = 0
    best.add(open_, np.where(scores > 0, millionths(scores), LOW), block.ids)


def _pairs_of_block(asked: _Questions, block: _Block, _, query_type, id_type) -> Iterator[pa.RecordBatch]:
    """True scores of the asked (question, document) pairs whose document lies in the block."""
    questions, docs = asked.pairs
    order = np.argsort(block.ids, kind="stable")
    at = np.minimum(np.searchsorted(block.ids[order], docs), len(order) - 1)
    here = np.flatnonzero(block.ids[order][at] == docs)
    if not len(here) or not len(block.known):
        return
    place, question = order[at[here]], questions[here]
    by_question = np.argsort(asked.question, kind="stable")
    first = np.searchsorted(asked.question[by_question], np.arange(len(asked.ids) + 1))
    n_terms = first[question + 1] - first[question]
    pair = np.repeat(np.arange(len(here)), n_terms)
    inside = np.arange(n_terms.sum()) - np.repeat(np.cumsum(n_terms) - n_terms, n_terms)
    entry = by_question[first[question[pair]] + inside]
    in_block = np.full(len(asked.terms), -1)
    in_block[block.known] = block.at
    width = len(block.ids)
    term = in_block[asked.term[entry]]
    keys = np.repeat(np.arange(len(block.end)), block.end - block.start) * width + block.places  # ascending by construction
    want = term * width + place[pair]
    spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = (term >= 0) & (keys[spot] == want)
    part = asked.qtf[entry] * asked.idf[asked.term[entry]] * asked.part(block.tfs[spot].astype(float), block.lengths[place[pair]])
    scores = np.bincount(pair, np.where(hit, part, 0.0), len(here))
    some = np.flatnonzero(scores > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([asked.ids[q] for q in question[some]], query_type), pa.array(docs[here[some]].tolist(), id_type), pa.array(millionths(scores[some]) / 1e6)],
        ["query_id", "doc_id", "score"],
    )


def _asked_map(source: TextSource, q_rows: list, body, k: int, types: tuple, pairs: list | None = None) -> DataFrame | None:
    text_batches(source.blocks.sparkSession)
    asked = _read_questions(source, q_rows)
    if asked is None:
        return None
    if pairs is not None:
        at = {q: i for i, q in enumerate(asked.ids)}
        pairs = [p for p in pairs if p["query_id"] in at]
        ids = as_ids(pa.array([p["doc_id"] for p in pairs], to_arrow_type(types[1])))
        asked.pairs = np.array([at[p["query_id"]] for p in pairs], int), ids
        if not pairs:
            return None
    shared = source.blocks.sparkSession.sparkContext.broadcast(asked)
    return source.rows().mapInArrow(_block_map(shared, body, *map(to_arrow_type, types), k), answer_schema(*types))


def _types(source: TextSource, q_terms: DataFrame) -> tuple:
    return q_terms.schema["query_id"].dataType, source.blocks.schema["doc_ids"].dataType.elementType


def text_topk(source: TextSource, q_terms: DataFrame, depth: int) -> DataFrame:
    """query_id, doc_id, score, rank: the `depth` best documents of every question; only documents that share a term.

    Questions go to all tasks in blocks of about QUESTION_TERMS words; a task maps its blocks once, skips a block for a
    question when the bounds say that nothing in it can get in, and hands on `depth` rows per question."""
    types = _types(source, q_terms)
    parts = [_asked_map(source, rows, _top_of_block, depth, types) for rows in question_blocks(q_terms, QUESTION_TERMS)]
    return merged([p for p in parts if p is not None], answer_schema(*types), source.blocks.sparkSession, depth)


def pair_scores(source: TextSource, q_terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of those pairs that share a term; pairs(query_id, doc_id) without repeats."""
    types = _types(source, q_terms)
    out = source.blocks.sparkSession.createDataFrame([], answer_schema(*types))
    for rows in question_blocks(q_terms, QUESTION_TERMS):
        ids = sorted({r["query_id"] for r in rows})
        own = pairs.select("query_id", "doc_id")
        few = own if len(ids) > 10_000 else own.where(F.col("query_id").isin(ids))
        for block in question_blocks(few, PAIRS):
            part = _asked_map(source, rows, _pairs_of_block, 1, types, block)
            out = out if part is None else out.unionByName(part)
    return out


PAIRS = 500_000
