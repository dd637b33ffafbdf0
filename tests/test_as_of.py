"""As-of joins against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.as_of import as_of_join


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_equals_a_loop(spark, slices):
    r = random.Random(slices)
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(40)]), "x") for i in range(300)]
    right = [(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(40)]), r.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)]
    a = spark.createDataFrame(left, "id int, k string, t int, slice string")
    b = spark.createDataFrame(right, "k string, t int, v double")
    got = {x["id"]: (x["k"], x["t"], x["slice"], x["last"]) for x in as_of_join(a, b, "k", "t", "v", "last", slices).collect()}

    def latest(k, t):
        fit = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        at = max((x[1] for x in fit), default=None)
        return max((x[2] for x in fit if x[1] == at and x[2] is not None), default=None)

    assert got == {i: (k, t, s, latest(k, t)) for i, k, t, s in left}


def test_two_keys_and_clashing_names(spark):
    a = spark.createDataFrame([(1, "p", 5, "row"), (1, "q", 5, "row"), (2, "p", 1, "row")], "k0 int, v string, t int, row string")
    b = spark.createDataFrame([(1, "p", 3, 7), (1, "q", 6, 8)], "k0 int, v string, t int, side int")
    assert sorted(map(tuple, as_of_join(a, b, ["k0", "v"], "t", "side", "side").collect()), key=str) == [(1, "p", 5, "row", 7), (1, "q", 5, "row", None), (2, "p", 1, "row", None)]


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 5)], "k int, t int")
    b = spark.createDataFrame([], "k int, t int, v int")
    assert [tuple(x) for x in as_of_join(a, b, "k", "t", "v", "last").collect()] == [(1, 5, None)]
    assert as_of_join(a.filter("false"), b, "k", "t", "v", "last").count() == 0


def test_a_hot_key_is_spread(spark):
    """One key with all rows goes to as many groups as there are slices."""
    a = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    b = spark.range(100).select(F.lit("hot").alias("k"), (F.col("id") * 100).alias("t"), F.col("id").alias("v"))
    out = as_of_join(a, b, "k", "t", "v", "last", 16)
    assert out.filter(F.col("last") != F.floor(F.col("t") / 100)).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        sizes = [x["n"] for x in as_of_join(a, b, "k", "t", "v", "last", 16).select("last", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("last").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([x for x in sizes if x]) >= 8 and max(sizes) <= 2600
