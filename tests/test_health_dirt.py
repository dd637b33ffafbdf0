"""Counts and rows of a finding agree on whatever a column holds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import health
from tidemill.operators.health import RowFilter
from tidemill.operators.steps import Step
from tidemill.plans.pipeline import check_limits, replay


@pytest.mark.parametrize(
    ("kind", "values", "repeated"),
    [
        ("timestamp_ntz", [dt.datetime(2020, 1, 1, 0, 0, 0, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 2)], 0), ("double", [0.0, -0.0, 1.0], 2), ("double", [float("nan"), float("nan"), None, None, 2.0], 4), ("string", ["a", None, None, "", "", " "], 4),
        ("array<int>", [[1], [1], [2], None], 2), ("binary", [b"\x00", b"\x00", b"\xff"], 2), ("decimal(10,4)", [], 0),
    ],
)
def test_repeats(spark, kind, values, repeated):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, k0 int")
    rows = RowFilter("duplicated_by", ("v",))
    assert health.count_affected(df, rows) == health.affected_rows(df, rows).count() == repeated


def test_all_case_variants_are_shown(spark):
    """2000 spellings in 1000 groups: more than a filter of values holds."""
    df = spark.range(2000).select(F.concat(F.when(F.col("id") % 2 == 0, "word").otherwise(" Word"), F.floor(F.col("id") / 2).cast("string")).alias("v"), F.lit("x").alias("normal"))
    found = next(f for f in health.analyse(df) if f.code == "case_variant_categories")
    assert found.affected == 2000 and found.counts["groups"] == 1000
    assert health.affected_rows(df, found.rows).count() == health.count_affected(df, found.rows) == 2000


def test_unique_counts_are_exact(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("few"), F.when(F.col("id") == 5, -0.0).otherwise(0.0).alias("zero"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("odd"), F.hex("id").cast("binary").alias("raw"), F.lit(None).cast("string").alias("none"))
    total, facts = health.column_facts(df)
    assert total == 3000 and {n: f["unique"] for n, f in facts.items()} == {"id": 3000, "few": 7, "zero": 1, "odd": 2, "raw": 3000, "none": 0}
    assert facts["id"]["quartiles"] == (749.0, 2249.0) and facts["odd"]["quartiles"] == (1.0, 1.0)


def test_empty_frames_have_no_findings(spark):
    assert health.analyse(spark.createDataFrame([], "a int, b string")) == []
    assert health.analyse(spark.createDataFrame([((1,),)], "a struct<x:int>")) == []


@pytest.mark.parametrize(("formula", "want"), [("a + 1", None), ("a - (-1)", None), ("a * 2", None), ("-b", None), ("abs(b)", None), ("b + 1", -(2**63) + 1), ("abs(b + 1)", 2**63 - 1), ("-c", -1.5), ("abs(c - 2)", 0.5), ("a * 1", 2**63 - 1), ("None + 1", None)])
def test_whole_numbers_that_do_not_fit_are_null(spark, formula, want):
    df = spark.createDataFrame([(2**63 - 1, -(2**63), 1.5)], "a long, b long, c double")
    assert replay(df, (Step("add_column", {"name": "x", "expression": formula}),)).first()["x"] == want


def test_limits_are_per_step():
    many = tuple(Step("rename_column", {"column": f"a{i}", "to": "b" * 440}) for i in range(190))
    check_limits(many)
    with pytest.raises(Exception, match="too large"):
        check_limits((Step("rename_column", {"column": "a", "to": "b" * 70_000}),))
