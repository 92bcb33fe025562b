"""Hit rates, parameter grids, ranks and run reports."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.operators.retrieve import fuse, normalise
from tablescout.operators.scaling import top_per_group
from tablescout.operators.vectors import embed_column

# Benchmark names and the question columns they read.
VARIANTS = {
    "BC1": "question_from_sql_1",
    "BC2": "question",
    "BX1": "question_bx1",
    "BX2": "question_bx2",
}
GRID_KEYS = ["k", "n", "alpha"]


def question_variants(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, variant, question) for every variant column the relation has."""
    present = {v: c for v, c in VARIANTS.items() if c in questions.columns}
    named = questions.select(key, *[F.col(c).alias(v) for v, c in present.items()])
    return named.unpivot([key], list(present), "variant", "question").where("question is not null")


def hits(tables: DataFrame, answers: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, hit): one of the first k tables is an answer. Answers are (query_id, table_id)."""
    found = (
        tables.where(F.col("rank") <= k).join(answers, ["query_id", "table_id"], "left_semi")
        .select("query_id").distinct().withColumn("_hit", F.lit(1))
    )
    return questions.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("_hit", F.lit(0)).alias("hit")
    )


def hit_rates(hit_rows: DataFrame, by: list[str]) -> DataFrame:
    return hit_rows.groupBy(*by).agg(
        F.round(F.avg("hit") * 100, 2).alias("hitrate"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("questions")
    )


def misses(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.where("hit = 0").drop("hit")


def grid(ks: list[int], ns: list[int], alphas: list[float]) -> list[tuple[int, int, float]]:
    return list(product(ks, ns, alphas))


def grid_depth(points: list[tuple[int, int, float]]) -> int:
    return max(k * n for k, n, _ in points)


def grid_hits(pooled: DataFrame, points: list[tuple[int, int, float]], is_answer: Column) -> DataFrame:
    """(k, n, alpha, query_id, hit) of all grid points in one plan.

    `pooled` holds the candidates of the deepest point with their ranks; a point
    keeps those within its own depth. A question contributes at most 2 * depth rows
    per point."""
    points_col = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(float(a)).alias("alpha")) for k, n, a in points
    ])
    each = pooled.withColumn("_ok", is_answer).withColumn("_p", F.explode(points_col)).select("*", "_p.k", "_p.n", "_p.alpha")
    depth = F.col("k") * F.col("n")
    within = each.where(
        (F.coalesce("text_rank", F.lit(2147483647)) <= depth) | (F.coalesce("vector_rank", F.lit(2147483647)) <= depth)
    )
    by = [*GRID_KEYS, "query_id"]
    scored = fuse(normalise(within, by), F.col("alpha"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where("rank <= k")
    return ranked.groupBy(*by).agg(F.max(F.col("_ok").cast("int")).alias("hit"))


def tie_ranks(ranked: DataFrame) -> DataFrame:
    """Rank grows only when the score drops; a question has at most its depth of rows."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    return ranked.withColumn("tie_rank", F.dense_rank().over(w))


def mention_hits(responses: DataFrame) -> DataFrame:
    named = F.exists("answer_tables", lambda t: F.contains(F.col("response"), F.concat(t, F.lit(".csv"))))
    return responses.withColumn("hit", named.cast("int"))


def throughput(runs: DataFrame, phase: str, seconds: str) -> DataFrame:
    """(phase, n, seconds, per_second) with one more row over all phases."""
    each = runs.groupBy(phase).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds"))
    total = each.agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).select(F.lit("ALL").alias(phase), "n", "seconds")
    return each.unionByName(total).select(
        phase, "n", F.round("seconds", 4).alias("seconds"), F.round(F.col("n") / F.col("seconds"), 6).alias("per_second")
    )


def best_runs(runs: DataFrame, batch: str, metric: str, seconds: str, key: str, keep: int = 10) -> DataFrame:
    return top_per_group(runs, [batch, metric], [F.col(seconds), F.col(key)], keep, "run")


def first_questions(questions: DataFrame, by: str, key: str, cap: int = 50) -> DataFrame:
    return top_per_group(questions, [by], [F.col(key)], cap, "q_no")


def precompute_embeddings(variants: DataFrame, path: str, embed=None, dim: int = 64) -> DataFrame:
    """Question vectors once, stored per variant."""
    vectors = embed_column(variants, "question", embed, dim)
    vectors.drop("question").write.partitionBy("variant").parquet(path)
    return variants.sparkSession.read.parquet(path)


def annotation_diff(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """Questions with at most one equality condition whose answer tables changed."""
    few = F.size(F.filter("where", lambda c: c["op"] == "=")) <= 1
    both = new.where(few).select(key, F.col("answer_tables").alias("_new")).join(
        old.select(key, F.col("answer_tables").alias("_old")), key
    )
    return both.select(
        key, F.array_sort(F.array_except("_new", "_old")).alias("added"), F.array_sort(F.array_except("_old", "_new")).alias("removed")
    ).where((F.size("added") > 0) | (F.size("removed") > 0))
