"""Joins deal out hot keys only where there are some."""

from pyspark.sql import functions as F

from korpusflow.llm.common import hot_keys, spread_join


def test_even_tables_have_no_hot_keys(spark):
    even = spark.range(5000).selectExpr("id AS k", "3L AS n")
    assert hot_keys(even, ["k"]) is None and hot_keys(even.filter("false"), ["k"]) is None
    many = spark.range(15_000).selectExpr("id % 5000 AS k", "id AS v")
    got = spread_join(many, even.select("k", (F.col("k") * 2).alias("w")), ["k"], None, F.col("v"))
    assert got.columns == ["k", "v", "w"] and got.agg(F.count("v"), F.sum(F.col("w") - 2 * F.col("k"))).first() == (15_000, 0)


def test_hot_keys_are_dealt_out(spark):
    many = spark.range(3000).selectExpr("if(id < 2000, 0L, id) AS k", "id AS v")
    counted = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counted, ["k"])
    assert [(r.k, r["__parts"]) for r in hot.collect()] == [(0, 10)]
    got = spread_join(many, counted, ["k"], hot, F.col("v"))
    assert got.agg(F.count("v"), F.max("n")).first() == (3000, 2000)
