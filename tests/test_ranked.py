"""Order statistics against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import column_stats
from tidemill.operators.ranked import competition_ranks, percentiles, running_total, value_counts


def test_running_total_crosses_ranges(spark):
    counted = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["upto"] for r in running_total(counted, [F.desc("id")]).collect()}
    total = 0
    for i in range(4999, -1, -1):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("size", [1, 2, 3, 10, 999])
def test_percentiles_equal_numpy(spark, size):
    rng = np.random.default_rng(size)
    a, b = rng.normal(size=size), rng.integers(0, 5, size).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if i % 4 else None, 0.0 if i % 2 else -0.0) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    counted = value_counts(df, {c: F.col(c) for c in df.columns})
    kept = [y for i, y in enumerate(b) if i % 4]
    linear = {(r["column"], r["fraction"]): r["value"] for r in percentiles(counted, fractions).collect()}
    nearest = {(r["column"], r["fraction"]): r["value"] for r in percentiles(counted, fractions, nearest_rank=True).collect()}
    for name, values in (("a", a), ("b", kept), ("c", [0.0] * size)):
        for f in fractions if len(values) else []:
            assert linear[name, f] == pytest.approx(np.quantile(values, f))
            assert nearest[name, f] == sorted(values)[max(math.ceil(f * len(values)), 1) - 1]
    assert size > 1 or ("b", 0.5) not in linear


def test_percentiles_of_all_distinct_values(spark):
    df = spark.range(50_001).select(((F.col("id") * 7919) % 50_001).cast("double").alias("v"))
    got = {r["fraction"]: r["value"] for r in percentiles(value_counts(df, {"v": F.col("v")}), [0.25, 0.5, 0.999]).collect()}
    assert got == {0.25: 12_500.0, 0.5: 25_000.0, 0.999: pytest.approx(49_950.0)}


def test_summary_of_odd_columns(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "v double")
    row = column_stats.numeric_summary(df, "v").first()
    assert (row["rows"], row["nulls"], row["distinct"], row["median"]) == (4, 1, 4, 3.0)
    empty = column_stats.numeric_summary(df.filter("false"), "v").collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, None, None, None, None, None, None, None)]


def test_competition_ranks(spark):
    r = random.Random(1)
    scores = [r.choice([None, 0.5, 0.25, r.random()]) for _ in range(300)]
    got = competition_ranks(spark.createDataFrame(list(enumerate(scores)), "id int, score double"), "score").collect()
    known = [s for s in scores if s is not None]
    assert {x["id"]: x["rank"] for x in got} == {i: None if s is None else 1 + sum(t > s for t in known) for i, s in enumerate(scores)}
