"""A training-data pipeline over documents: language, near duplicates, source mix, piece ids.

Every stage works on all that its predecessor kept, is written as Parquet to the shared folder and read
back as the next one's documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import written
from tablescout.llm.language_id import UNKNOWN, identify, train
from tablescout.llm.ngram_join import text_groups
from tablescout.llm.sentence_pieces import encode_pieces
from tablescout.llm.source_mix import mix

LEAST_SCORE = 0.25
WORDS, PERCENT = 5, 80
VOCABULARY = "piece_bpe_32k.model"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language can be told: those without a letter go, and those whose most
    likely language has a probability under LEAST_SCORE, which is no more than a guess among four.

    The model learns from the labelled documents outside the held-out fold (crc32 of the id mod 4 is 2)."""
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    told = identify(docs, model)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id: five-word
    shingles, Jaccard of 0.8 or more. A row that repeats id and text stays once. Of a group in which no
    row has an id the text with the smallest hash stays once; texts without words are groups of their own."""
    groups = written(text_groups(docs, WORDS, PERCENT), "near-groups")
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    named = keyed.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "_text"])
    nameless = keyed.where("doc_id is null")
    lone = groups.where("doc_id is null and component_id is null and n_shingles > 0").groupBy("root").agg(F.min("text_key").alias("_text"))
    blank = groups.where("doc_id is null and n_shingles = 0").select(F.col("text_key").alias("_text")).distinct()
    kept = [named, nameless.join(lone, "_text", "left_semi").dropDuplicates(["_text"]), nameless.join(blank, "_text", "left_semi")]
    return reduce(DataFrame.unionByName, [k.select(*docs.columns) for k in kept])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mix takes it: 0, 1 or 2 times."""
    mixed = mix(docs)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = mixed.withColumn("_copies", copies).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and piece_ids of every document of the mix."""
    import public_tokenizers

    encoded = encode_pieces(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("source_mix", mix_stage),
    ("pieces", piece_stage),
]

#: No SQL says what a trained classifier, a seeded subset sum or a vocabulary does; tests compare each stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
