from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescout.operators import scaling as S


def test_ordinal_equals_a_plain_window_with_many_chunks(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") * 7).alias("k")
    )
    got = S.ordinal(df, "pos", ["g"], "k", chunk=100)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.join(want, ["g", "k"]).where("pos <> want").count() == 0
    assert got.count() == 2000


def test_ordinal_with_a_coarse_order_over_all_rows(spark):
    df = spark.range(500).select("id", (F.col("id") % 4).alias("len"))
    got = S.ordinal(df, "pos", [], "id", [("len", False)], chunk=50).orderBy("pos").collect()
    assert [(r["len"], r["id"]) for r in got] == sorted(((i % 4, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert [r["pos"] for r in got] == list(range(500))


def test_salted_join_keeps_every_row_of_a_hot_key(spark, monkeypatch):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("absent", 4)], "k string, v int")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    monkeypatch.setattr(S, "hot_keys", lambda c, keys, n="n": c.where(F.col(n) > 100).select(*keys, F.lit(7).alias("_salts")))
    got = S.salted_join(big, small, counts, ["k"], ["id"])
    assert got.columns == ["k", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_keys_beyond_one_task_are_cut_at_every_size(spark):
    counts = spark.createDataFrame([("a", 900_000), ("b", 150_000), ("c", 10), ("rest", 10**12)], "k string, n long")
    assert {r["k"]: r["_salts"] for r in S.hot_keys(counts, ["k"]).collect()} == {"a": 9, "b": 2, "rest": 10_000_000}
