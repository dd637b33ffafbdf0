"""Constraints, fronts, and how far a decision bears other weights and noise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.operators import decision, robust, skyline

WAYS = {"a": "max", "b": "min", "c": "max"}


def rows_of(spark, n, seed, levels=6):
    r = random.Random(seed)
    rows = [(i, *(float(r.randrange(levels)) for _ in range(3))) for i in range(n)]
    rows += [(n, None, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0), (n + 2, float("inf"), 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(7)


def beats(x, y):
    return x[1] >= y[1] and x[2] <= y[2] and x[3] >= y[3] and (x[1] > y[1] or x[2] < y[2] or x[3] > y[3])


@pytest.mark.parametrize(("n", "levels", "block"), [(1, 3, 4096), (300, 4, 4096), (600, 1000, 32), (400, 1, 16)])
def test_fronts_and_dominators(spark, n, levels, block):
    rows, df = rows_of(spark, n, n, levels)
    sound = rows[:n]
    front = {x[0] for x in sound if not any(beats(y, x) for y in sound)}
    assert {r["id"] for r in skyline.pareto(df, "id", WAYS, block).collect()} == front
    got = {r["id"]: r["dominated_by"] for r in skyline.dominated(df, "id", WAYS, block).collect()}
    assert got == {x[0]: min((y[0] for y in sound if y[0] in front and beats(y, x)), default=None) for x in sound}


def test_front_of_many_anticorrelated_rows(spark):
    """100 000 rows, half of them on the front."""
    df = spark.range(100_000).select("id", (F.floor(F.col("id") / 2) * 1.0).alias("a"), (-F.floor(F.col("id") / 2) - F.col("id") % 2).cast("double").alias("b"))
    front = skyline.pareto(df, "id", {"a": "max", "b": "max"})
    assert "BroadcastNestedLoopJoin" not in front._jdf.queryExecution().executedPlan().toString()
    got = front.agg(F.count("*").alias("n"), F.sum(F.col("id") % 2).alias("odd")).first()
    assert (got["n"], got["odd"]) == (50_000, 0)


def test_first_dominator_keeps_equal_rows():
    x = np.array([[1.0, 2], [1, 2], [0, 2], [1, 1], [2, 0]])
    assert skyline.first_dominator(x, x).tolist() == [-1, -1, 0, 0, -1]


def test_topsis_keeps_incomplete_rows(spark):
    rows = [(1, 0.9, 10.0), (2, 0.8, 5.0), (3, 0.7, 20.0), (4, None, 1.0), (5, float("nan"), 1.0)]
    got = {r["k"]: (r["closeness"], r["rank"]) for r in decision.topsis(spark.createDataFrame(rows, "k int, q double, ms double"), "k", {"q": "max", "ms": "min"}, {"q": 0.6, "ms": 0.4}).collect()}
    assert [(round(got[k][0], 6), got[k][1]) for k in (1, 2, 3)] == [(0.690431, 2), (0.860346, 1), (0.0, 3)]
    assert got[4] == got[5] == (None, None)


def test_states_and_ranking(spark):
    rows = [(1, 0.9, 10.0, 3.0), (2, 0.8, 5.0, None), (3, 0.7, 20.0, 9.0), (4, None, 1.0, 3.0), (5, 0.6, 30.0, 3.0), (6, 0.95, 11.0, 3.0), (7, 0.95, 11.0, 3.0)]
    df = spark.createDataFrame(rows, "k int, q double, ms double, mb double")
    got = {r["k"]: r for r in robust.robust_ranking(df, "k", {"q": "max", "ms": "min", "mb": "min"}, {"q": 0.6, "ms": 0.4, "mb": 0}, [robust.Constraint("mb", "<=", 5)]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "pareto", 2: "unverified", 3: "infeasible", 4: "incomplete", 5: "dominated", 6: "pareto", 7: "pareto"}
    assert got[5]["dominated_by"] == 1 and got[3]["violated"] == ["mb <= 5"] and got[2]["unverified"] == ["mb <= 5"] and got[4]["missing"] == ["q"]
    assert got[6]["rank"] == got[7]["rank"] and all((r["rank"] is None) == (r["status"] != "pareto") for r in got.values())


@pytest.mark.parametrize(
    ("rows", "weights", "constraints"),
    [
        ([(1, 1.0)], {"q": 1}, []), ([(1, 1.0), (1, 2.0)], {"q": 1}, []), ([(1, 1.0), (None, 2.0)], {"q": 1}, []), ([(1, 1.0), (2, 2.0)], {"q": 0}, []), ([(1, 1.0), (2, 2.0)], {"q": -1}, []), ([(1, 1.0), (2, 2.0)], {"q": float("nan")}, []),
        ([(1, 1.0), (2, 2.0)], {"q": 1}, [robust.Constraint("z", "<=", 1)]), ([(1, 1.0), (2, 2.0)], {"q": 1}, [robust.Constraint("q", "<", 1)]), ([(1, 1.0), (2, 2.0)], {"q": 1}, [robust.Constraint("q", "<=", float("inf"))]),
    ],
)
def test_problems_without_an_answer_are_refused(spark, rows, weights, constraints):
    with pytest.raises(PreparationError):
        robust.robust_ranking(spark.createDataFrame(rows, "k int, q double"), "k", {"q": "max"}, weights, constraints)


def test_intervals_of_two_criteria(spark):
    df = spark.createDataFrame([("x", 1.0, 0.0), ("y", 0.0, 1.0), ("z", None, 5.0)], "k string, a double, b double")
    got = [tuple(r) for r in robust.weight_intervals(df, "k", {"a": "max", "b": "max"}, {"a": 0.7, "b": 0.3}, 0.1).orderBy("criterion", "segment").collect()]
    assert [(r[0], r[2], round(r[3], 6), round(r[4], 6), r[5], r[6]) for r in got] == [("a", 1, 0.0, 0.4, "y", False), ("a", 2, 0.5, 1.0, "x", True), ("b", 1, 0.0, 0.5, "x", True), ("b", 2, 0.6, 1.0, "y", False)]
    only = [tuple(r) for r in robust.weight_intervals(df, "k", {"a": "max"}, {"a": 2}).collect()]
    assert only == [("a", 1.0, 1, 0.0, 1.0, "x", True)]
    with pytest.raises(PreparationError):
        robust.weight_intervals(df, "k", {"a": "max"}, {"a": 2}, 0.5)


def test_draws_do_not_depend_on_the_partitioning(spark):
    _, df = rows_of(spark, 40, 5, 1000)
    df = df.withColumn("sd", F.lit(200.0))
    shares = lambda d: {r["id"]: r["share"] for r in robust.noise_shares(d, "id", WAYS, {"a": "sd"}, {"a": 1, "b": 1, "c": 1}, 200).collect()}
    one, two = shares(df.coalesce(1)), shares(df.repartition(5, "b"))
    assert one == two and sum(one.values()) == pytest.approx(1) and len(one) > 1
    weights = lambda d: {r["id"]: r["share"] for r in robust.weight_shares(d, "id", WAYS, samples=200).collect()}
    assert weights(df.coalesce(1)) == weights(df.repartition(5, "b"))


def test_draws_are_normal(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(robust.normal_draw(1, F.col("id"))).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x > 1).mean() - 0.1587) < 0.01


def test_recommendation(spark):
    df = spark.createDataFrame([(1, 0.9, 10.0), (2, 0.8, 5.0), (3, 0.7, 20.0)], "k int, q double, ms double").withColumn("sd", F.lit(0.01))
    args = ("k", {"q": "max", "ms": "min"}, {"q": 0.6, "ms": 0.4})
    one = robust.recommendation(df, *args, stds={"q": "sd"}, samples=300).first()
    assert (one["winner"], one["feasible"], one["front"], one["verdict"]) == (2, 3, 2, "stable") and one["noise_share"] > 0.9 and one["local_share"] > 0.6
    none = robust.recommendation(df, *args, [robust.Constraint("q", ">=", 2)], samples=10).first()
    assert tuple(none) == (None, 0, 0, None, None, "none")
    alone = robust.recommendation(df, *args, [robust.Constraint("ms", "<=", 5)], samples=10).first()
    assert (alone["winner"], alone["front"], alone["verdict"]) == (2, 1, "stable")


def test_influence_of_a_flat_criterion(spark):
    df = spark.createDataFrame([(0.90, 1.0), (0.91, 50.0)], "q double, ms double")
    got = {r["criterion"]: r["influence"] for r in robust.influence(df, {"q": "max", "ms": "min"}, {"q": 0.8, "ms": 0.2}).collect()}
    assert got["q"] < 0.1 and sum(got.values()) == pytest.approx(1)
