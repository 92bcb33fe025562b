"""What goes to Python at once is bounded by bytes, not by rows; so is what a task reads and writes at once."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablescout import session
from tablescout.functions import stemming as ST
from tablescout.operators import groundtruth as GT
from tablescout.operators import indexing as IX
from tablescout.operators import textindex as X
from tablescout.operators import vectors as V

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def fresh(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.set(LIMIT, before)


def docs(spark, n=30):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("running dogs ran quickly").alias("text"))


@pytest.mark.parametrize("step", [
    lambda s: X.postings(docs(s).withColumn("terms", F.split("text", " "))),
    lambda s: X.text_blocks(docs(s).withColumn("terms", F.split("text", " "))),
    lambda s: X.analyze(docs(s)),
    lambda s: V.embed_column(docs(s)),
    lambda s: GT.judge_titles(s.createDataFrame([("q", "t", "a", "b")], "question_id string, table_id string, entity string, title string")),
])
def test_steps_bound_their_batches(fresh, step):
    step(fresh)
    assert int(fresh.conf.get(LIMIT)) == session.BATCH_BYTES


def test_blocks_hold_few_long_documents(fresh):
    long = fresh.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit("x" * 100), 1_000).alias("terms"))
    sizes = [len(r["doc_ids"]) for r in X.text_blocks(long).collect()]
    assert sum(sizes) == 200 and max(sizes) <= 100


def test_a_block_is_a_row_group(fresh, tmp_path):
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), (i * 40 + F.col("id")).cast("string")))
    long = fresh.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    IX.write_fulltext(long, str(tmp_path), stem=False)
    [file] = glob.glob(f"{tmp_path}/blocks/*.parquet")
    stored, blocks = pq.ParquetFile(file).metadata, fresh.read.parquet(file).select(F.size("doc_ids").alias("n")).collect()
    assert len(blocks) > 5 and sum(r["n"] for r in blocks) == 40
    assert [stored.row_group(i).num_rows for i in range(stored.num_row_groups)] == [1] * len(blocks)


def test_a_block_is_scored_for_few_questions_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    terms = [[f"w{t}" for t in rng.integers(0, 9, 6)] for _ in range(50)]
    row = X._block(pa.array(range(50)), pa.array(terms), None).append_column("gone", pa.array([[3, 4]], pa.list_(pa.int32())))
    words = [f"w{t}" for t in range(9)]
    term, question = np.repeat(np.arange(9), 30), np.tile(np.arange(30), 9)
    keep = rng.random(270) < 0.4
    asked = X._Questions(list(range(30)), words, term[keep], question[keep], np.ones(keep.sum()), np.linspace(0.5, 2, 9), 6.0)
    cells = []

    class Watched(X.Best):
        def add(self, rows, scores, ids):
            cells.append(scores.size)
            super().add(rows, scores, ids)

    def found():
        best = Watched(30, 4)
        list(X._top_of_block(asked, X._Block(row, 0, pa.array(words)), best))
        return best.score.tolist(), best.id.tolist()

    want = found()
    assert max(cells) > 200
    cells.clear()
    monkeypatch.setattr(X, "SCORES", 200, raising=False)
    assert found() == want and max(cells) <= 200


def test_blocks_stay_where_they_are_when_documents_are_deleted(spark, tmp_path, monkeypatch):
    """Even if Spark broadcasts nothing by itself, and with the blocks read in parts."""
    at, limit = str(tmp_path / "index"), "spark.sql.autoBroadcastJoinThreshold"
    text = F.concat(F.lit("common word"), (F.col("id") % 11).cast("string"))
    corpus = spark.range(0, 60, 1, 6).select(F.col("id").alias("doc_id"), F.lit("t").alias("table_id"), F.lit("content").alias("kind"), text.alias("text"))
    IX.build_index(corpus, at, stem=False)
    plans, lost, before = [], X.lost_terms, spark.conf.get(limit)
    monkeypatch.setattr(X, "lost_terms", lambda hit: plans.append(hit._jdf.queryExecution().executedPlan().toString()) or lost(hit))
    monkeypatch.setattr(X, "GONE_PLACES", 5, raising=False)
    spark.conf.set(limit, "-1")
    try:
        IX.delete_documents(spark, at, corpus.select("doc_id").where("doc_id % 3 = 0"))
        source = IX.text_source(spark, at)
        plans.append(source.rows()._jdf.queryExecution().executedPlan().toString())
        assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans) and len(plans) == 2
        rows = source.rows().select("doc_ids", "gone").collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted(d for r in rows for d in r["doc_ids"]) == list(range(60))
    assert sorted(r["doc_ids"][p] for r in rows for p in r["gone"] or []) == list(range(0, 60, 3))
    asked = X.query_terms(spark.createDataFrame([(1, "common")], "query_id long, query string"), stem=False)
    left = X.text_topk(source, asked, 60).collect()
    assert sorted(r["doc_id"] for r in left) == [i for i in range(60) if i % 3]
    assert {r["df"] for r in source.terms.where("term = 'common'").groupBy("term").agg(F.sum("df").alias("df")).collect()} == {40}


def test_filing_holds_few_products(monkeypatch):
    assert V._rows_at_once(V.MAX_PIVOTS) * V.MAX_PIVOTS <= V.PRODUCTS and V._rows_at_once(2 * V.PRODUCTS) == 1


def test_pieces_of_products_give_the_same_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(90, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "doc_id long, vector array<double>")
    asked = vectors.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")

    def answers():
        pivots, filed = V.pivot_lists(vectors)
        return sorted(map(tuple, V.lists_topk(asked, filed, pivots, 3).collect()))

    want = answers()
    monkeypatch.setattr(V, "PRODUCTS", 100)
    assert answers() == want and len(want) == 27


def test_stems_of_null_and_empty_rows_and_slices(spark):
    rows = [["running", "dogs"], None, [], ["dogs"]]
    got = ST.stem_terms.func(pa.array([["cut"], *rows], pa.list_(pa.string())).slice(1)).to_pylist()
    assert got == [["run", "dog"], None, [], ["dog"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    assert [r["s"] for r in df.select("i", ST.stem_terms("t").alias("s")).orderBy("i").collect()] == got
