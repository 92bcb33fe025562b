"""Places of rows without one-task sorts."""

import random

from pyspark.sql import functions as F

from tablescout.operators.scaling import ranked


def _want(rows, grouped):
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    out, at, start = {}, {}, {}
    for place, r in enumerate(sorted(rows, key=key)):
        g = r[0] if grouped else "-"
        start.setdefault(g, place if grouped else 0)
        out.setdefault((r[0], r[1]), set()).add((at.get(g, 0), start[g]))
        at[g] = at.get(g, 0) + 1
    return out, at


def test_places_with_sparse_keys_hot_groups_nulls_and_ties(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.5 else draw.choice(["a", "b", "ü", None]), draw.choice([None, 5, draw.randrange(10**15)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, k long")
    for group in (["g"], []):
        order = [F.col("k").asc_nulls_first()] if group else [F.col("g").asc_nulls_first(), F.col("k").asc_nulls_first()]
        want, sizes = _want(rows, bool(group))
        seen = {}
        for r in ranked(df, group, order, start="start", size="size").collect():
            seen.setdefault((r["g"], r["k"]), set()).add((r["rank"], r["start"]))
            assert r["size"] == sizes[r["g"] if group else "-"]
        assert seen == want


def test_no_window_without_keys_and_empty_table(spark):
    df = spark.range(50).withColumn("g", F.lit(None).cast("string"))
    plan = ranked(df, ["g"], [F.col("id")])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert ranked(df.where("id < 0"), ["g"], [F.col("id")]).count() == 0
    assert ranked(df.where("id < 0"), [], [F.col("id")], size="n").count() == 0
