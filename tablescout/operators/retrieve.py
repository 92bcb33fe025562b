"""Hybrid retrieval of a whole question batch as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions.text import table_of_doc
from tablescout.operators.scaling import BROADCAST_ROWS, fits, top_per_group
from tablescout.operators.textindex import TextSource, pair_scores, text_topk
from tablescout.operators.vectors import cosine, vector_topk
from tablescout.session import materialize

RERANK_MODES = ("NONE", "COSINE", "LLM", "DIRECT_SCORE")


def as_queries(spark, queries: str | list[str] | DataFrame) -> DataFrame:
    """(query_id, query) from one text, a list of texts, or a prepared DataFrame."""
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "query")
    texts = [queries] if isinstance(queries, str) else list(queries)
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def candidate_depth(k, n, corpus_size) -> Column:
    return F.least(k * n, corpus_size)


def candidates(text_top: DataFrame, vector_top: DataFrame) -> DataFrame:
    """Union of both result lists with the rank a document had in each (null: not in that list)."""
    t = text_top.select("query_id", "doc_id", F.col("rank").alias("text_rank"))
    v = vector_top.select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    return t.join(v, ["query_id", "doc_id"], "full_outer")


def complete_scores(
    cands: DataFrame, text_scores: DataFrame, queries: DataFrame, vectors: DataFrame, most: int | None = None
) -> DataFrame:
    """True scores of both retrievers for every candidate; text_scores hold the candidates that share a term.

    `most` is a bound on the number of candidates (questions * 2 * depth); only a small bound broadcasts them."""
    few = fits(cands) if most is None else most <= BROADCAST_ROWS
    side = F.broadcast(cands) if few else cands
    pairs = (
        vectors.select("doc_id", F.col("vector").alias("dv"))
        .join(side, "doc_id")
        .join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    )
    vec = pairs.select(
        "query_id", "doc_id", "text_rank", "vector_rank", F.round(cosine("qv", "dv"), 6).alias("vector_score")
    )
    text = text_scores.select("query_id", "doc_id", F.col("score").alias("text_score"))
    return vec.join(text, ["query_id", "doc_id"], "left").withColumn("text_score", F.coalesce("text_score", F.lit(0.0)))


def min_max(c: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(c) - lo) / (hi - lo))


def normalise(completed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Min-max per question and retriever; at most 2 * depth rows share a question."""
    by = by or ["query_id"]
    return completed.withColumn("text_norm", min_max("text_score", by)).withColumn(
        "vector_norm", min_max("vector_score", by)
    )


def fuse(normed: DataFrame, alpha) -> DataFrame:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return normed.withColumn("score", F.round(a * F.col("text_norm") + (1 - a) * F.col("vector_norm"), 6))


def rank_documents(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    return top_per_group(scored, by or ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def pooled_candidates(
    text: TextSource, q_terms: DataFrame, queries: DataFrame, vectors: DataFrame, depth: int, near: DataFrame | None = None
) -> DataFrame:
    """Candidates of both retrievers up to `depth` with completed scores. `near` replaces the exact vector answers."""
    near = vector_topk(queries, vectors, depth) if near is None else near
    cands = materialize(candidates(text_topk(text, q_terms, depth), near), "candidates")  # at most 2 * depth rows per question
    scores = pair_scores(text, q_terms, cands)
    return complete_scores(cands, scores, queries, vectors, queries.count() * 2 * depth)


def hybrid_candidates(
    text: TextSource, q_terms: DataFrame, queries: DataFrame, vectors: DataFrame, depth: int, near: DataFrame | None = None
) -> DataFrame:
    """Normalised scores of both retrievers for the pooled candidates of every question."""
    return normalise(pooled_candidates(text, q_terms, queries, vectors, depth, near))


def hybrid_search(
    text: TextSource, q_terms: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, n: int, alpha: float,
    near: DataFrame | None = None,
) -> DataFrame:
    """k*n fused documents per question, best first."""
    return rank_documents(fuse(hybrid_candidates(text, q_terms, queries, vectors, k * n, near), alpha), k * n)


def relevance_prompt(kind: Column, doc: Column, query: Column) -> Column:
    # Fixed texts of the two judge prompts.
    head = F.when(kind == "content", F.lit("Given a table with the following columns:\n*/\n")).otherwise(
        F.lit("Given this context describing a table:\n*/\n")
    )
    return F.concat(
        head, doc, F.lit("\n*/\nand this question:\n/*\n"), query,
        F.lit("\n*/\nIs the table relevant to answer the question? Begin your answer with yes/no."),
    )


def says_yes(answer) -> Column:
    return F.lower(answer).startswith("yes")


def judge_rerank(ranked: DataFrame, relevant: Column, by: list[str] | None = None) -> DataFrame:
    """Documents judged relevant move to the front; the order inside both parts stays."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(relevant.desc(), F.col("rank"))
    return ranked.withColumn("relevant", relevant).withColumn("rank", F.row_number().over(w))


def score_rerank(ranked: DataFrame, score: Column, by: list[str] | None = None) -> DataFrame:
    """New order by a second score, ties by document id."""
    rescored = ranked.withColumn("score", F.round(score, 6))
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col("score").desc(), F.col("doc_id"))
    return rescored.withColumn("rank", F.row_number().over(w))


def rerank(ranked: DataFrame, mode: str = "NONE", relevant: Column | None = None, score: Column | None = None) -> DataFrame:
    if mode not in RERANK_MODES:
        raise ValueError(f"unknown re-rank mode {mode}")
    if mode == "LLM":
        return judge_rerank(ranked, relevant)
    if mode in ("COSINE", "DIRECT_SCORE"):
        return score_rerank(ranked, score)
    return ranked


def overlap_score(query_terms: Column, doc_terms: Column) -> Column:
    """Offline pair scorer: share of the question's distinct terms found in the document."""
    asked = F.array_distinct(query_terms)
    return F.size(F.array_intersect(asked, doc_terms)) / F.greatest(F.size(asked), F.lit(1))


def tables_of(ranked: DataFrame, k: int, table: Column | None = None) -> DataFrame:
    """Cut to k documents, then one row per table at the place of its best document.

    k limits documents, so a question may get fewer than k tables."""
    table = table if table is not None else table_of_doc(F.col("doc_id"))
    best = (
        ranked.where(F.col("rank") <= k)
        .groupBy("query_id", table.alias("table_id"))
        .agg(F.min("rank").alias("doc_rank"))
    )
    w = Window.partitionBy("query_id").orderBy("doc_rank")
    return best.withColumn("rank", F.row_number().over(w))


def nest_results(tables: DataFrame, queries: DataFrame) -> DataFrame:
    """{query, retrieved_tables[]} per question; the array has at most k entries."""
    lists = tables.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "table_id"))), lambda x: x["table_id"]).alias(
            "retrieved_tables"
        )
    )
    return queries.join(lists, "query_id", "left").select(
        "query_id", "query",
        F.coalesce("retrieved_tables", F.array().cast("array<string>")).alias("retrieved_tables"),
    )
