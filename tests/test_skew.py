from pyspark.sql import functions as F

from vigil.operators import skew

SCHEMA = "g string, k string, v string, n bigint"


def test_heavy_keys_hot_null_and_threshold(spark):
    rows = [("a", "hot", "x", 1)] * 700 + [("a", None, "x", 1)] * 290 + [("a", "at", "y", 1)] * 10 + [("b", f"k{i}", "y", 1) for i in range(200)] + [("b", "one", "y", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in skew.heavy_keys(df, "g", "k").collect()}
    assert got == {("a", "hot"), ("a", "at")}  # 10 of 1000 is exactly 1 %; 2 of 202 is below; null is no key


def test_heavy_keys_empty(spark):
    assert skew.heavy_keys(spark.createDataFrame([], SCHEMA), "g", "k").collect() == []


def test_combine_distinct_with_nulls_and_repeated_rows(spark):
    rows = [("a", "k", "x", 1), ("a", "k", "x", 1), ("a", "k", None, 5), ("a", None, "z", 2), ("a", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__n", F.lit(1)).withColumn("n_rows", F.lit("clash"))
    out = skew.combine_by_key(df, ["g", "k"], [F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total")], {"values": "v"})
    assert {tuple(r) for r in out.collect()} == {("a", "k", 3, 7, 1), ("a", None, 2, 2, 1)}


def test_release_removes_what_was_written(spark):
    from vigil.session import release, written

    kept = written(spark.range(3), "some")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert kept.count() == 3 and os.path.isdir(path)
    release(spark)
    assert not os.path.isdir(path)
