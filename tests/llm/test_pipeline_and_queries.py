"""The registered queries against SQL or brute force, and the pipeline stage by stage."""

import os

import duckdb
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablescout.llm.common import read_table
from tablescout.llm.queries import ORACLES, QUERIES
from test_small_tables import plain_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, name):
    ok, note = parity.compare(spark, parity.duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def rows_of(table, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{table}.parquet'").fetchall()


def test_a_query_for_every_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_token_counts_query(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, len(t.encode()), len(whole.encode(t, add_special_tokens=False))) for i, t in rows_of("documents", "doc_id, text")}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in QUERIES["op1_token_counts"](spark, SF).collect()} == want


def test_held_out_languages(spark):
    lang = dict(rows_of("documents", "doc_id, lang"))
    held = [r for r in QUERIES["op2_language_id"](spark, SF).collect() if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_pieces_query_round_trips(spark):
    out = QUERIES["op7_sentence_pieces"](spark, SF)
    assert out.count() == len(rows_of("documents", "doc_id")) and out.where("not round_trip").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).union(spark.createDataFrame([(70_000, "12345 !!", "en", "s", 8), (70_001, None, None, None, None)], docs.schema))
    at = docs.unionByName(extra).cache()
    (_, language), (_, near), (_, mixed), (_, pieces) = corpus_pipeline.STAGES
    kept = language(spark, at, SF).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in at.collect()} - {r.doc_id for r in kept.collect()} == {70_000, 70_001}
    single = near(spark, kept, SF).cache()
    want = plain_groups({(r.doc_id, r.text) for r in kept.collect()}, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, root) in want.items() if i == root)
    assert single.columns == docs.columns
    mix = mixed(spark, single, SF).cache()
    assert mix.columns == docs.columns and mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = pieces(spark, mix, SF)
    assert out.count() == mix.count() and out.where("n_pieces <> size(piece_ids)").count() == 0


def test_pipeline_of_an_empty_table(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        assert at.count() == 0


def test_queries_read_whole_tables(spark):
    n = read_table(spark, SF, "documents", "doc_id").count()
    for name in ("op5_source_mix", "op8_ngram_join", "op9_two_pass_shuffle"):
        assert QUERIES[name](spark, SF).count() == n


def test_one_of_several_copies_without_an_id_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near, other, both = " ".join(words + ["end"]), " ".join(words), " ".join(words[::-1])
    rows = [(None, near), (None, near), (None, other), (None, both), (None, both + " end"), (4, both), (None, None), (8, "of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert len(kept) == 4 and {(4, both), (None, None), (8, "of its own")} < set(kept)
    assert [t for i, t in kept if i is None and t] in ([near], [other])
