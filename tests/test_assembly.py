"""Roles, targets, leaks, purposes and relations of small tables."""

import pytest
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.operators import assembly


@pytest.fixture(scope="module")
def sales(spark):
    i = F.col("id")
    return spark.range(400).select(
        i.alias("row_id"), (i % 7).alias("model_id"), (i * 3.5 + (i % 11)).alias("price"), (i * 350.0 + (i % 11) * 100).alias("total"), (i % 2 == 0).alias("churned"), F.when(i % 4 != 0, (i % 3).cast("string")).alias("status"),
        F.when(i < 3, "rare").otherwise("common").alias("kind"), F.concat(F.lit("text "), (i % 300).cast("string")).alias("comment"), F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("day"), F.when(i % 3 == 0, i % 100).alias("gaps"), (i * 3.5).alias("price_usd"),
    )


def test_roles(sales):
    got = {r["column"]: r["role"] for r in assembly.column_roles(sales).collect()}
    assert got == {"row_id": "identifier", "model_id": "categorical", "price": "identifier", "total": "identifier", "churned": "boolean", "status": "categorical", "kind": "categorical", "comment": "text", "day": "datetime", "gaps": "numeric", "price_usd": "identifier"}
    assert {r["column"]: (r["unique"], r["missing"], r["least"]) for r in assembly.column_roles(sales).collect()}["status"] == (3, 100, 100)
    assert assembly.column_roles(sales.filter("false")).count() == 11 and assembly.column_roles(sales.select(F.array("row_id"))).count() == 0


def test_few_rows_are_no_identifiers(spark):
    assert [r["role"] for r in assembly.column_roles(spark.range(20).select(F.col("id").cast("double").alias("x"), F.col("id").alias("id"))).collect()] == ["categorical", "identifier"]


def test_targets_and_leaks(spark):
    i = F.col("id")
    df = spark.range(400).select((i % 300 * 2.0).alias("price"), (i % 300 * 200.0 + i % 2).alias("sum_in_cents"), (i % 300 * 2.0 + i % 7 * 40).alias("prices_old"), (i % 30).alias("size"), F.when(i < 8, 1).otherwise(0).alias("fraud"), F.when(i % 10 != 0, (i % 4).cast("string")).alias("segment"), F.when(i % 3 == 0, i % 50).alias("mostly_missing"))
    got = {t.column: t for t in assembly.target_candidates(df)}
    assert [t.column for t in assembly.target_candidates(df)][:3] == ["price", "prices_old", "fraud"] and "mostly_missing" not in got
    assert (got["price"].task, got["price"].rank_score, got["price"].hinted) == ("regression", 0.8, True)
    assert got["price"].leaks == (("sum_in_cents", 1.0), ("prices_old", "name"))
    assert (got["fraud"].task, got["fraud"].classes, got["fraud"].minority, got["fraud"].rank_score) == ("classification", 2, 0.02, 0.55) and len(got["fraud"].warnings) == 1
    assert (got["segment"].missing, got["segment"].rank_score, len(got["segment"].warnings)) == (0.1, 0.15, 1)
    assert assembly.leakage_suspects(df, "price") == got["price"].leaks


def test_purposes(spark, sales):
    assert assembly.purposes(sales) == ["analytics", "classification", "forecasting"]
    assert assembly.purposes(sales.limit(50)) == []  # too few rows, and no number of many values
    assert assembly.purposes(spark.range(300).select((F.col("id") % 100).alias("a"), (F.col("id") % 90).alias("b"))) == ["regression", "clustering"]


def test_relations(spark):
    i = F.col("id")
    clients = spark.range(300).select(i.alias("id"), (i % 5).cast("string").alias("segment"))
    orders = spark.range(900).select((i + 10_000).alias("order_id"), (i % 300).alias("client_id"), (i % 7 + 0.25).alias("price"))
    models = spark.range(30).select(F.concat(F.lit("m"), (i % 10).cast("string")).alias("model"), (i / 10).cast("int").alias("year"), (i * 1.5).alias("power"))
    sold = spark.range(120).select(F.concat(F.lit("m"), (i % 10).cast("string")).alias("model"), (i / 10 % 3).cast("int").alias("year"), (i * 1.5).alias("amount"))
    weather = spark.range(50).select(F.concat(F.lit("city"), i.cast("string")).alias("town"), F.concat(F.lit("sky"), (i % 3).cast("string")).alias("sky"))
    found = {(r.left, r.right): r for r in assembly.discover({"clients": clients, "orders": orders, "models": models, "sold": sold, "weather": weather})}
    best = found["clients", "orders"]
    assert best.advice == "join" and best.keys == (("id", "client_id"),) and best.candidates[0].cardinality == "1:N" and best.candidates[0].estimated == 900
    both = found["models", "sold"]
    assert both.advice == "join" and set(both.keys) == {("model", "model"), ("year", "year")} and both.candidates[0].cardinality == "1:N"
    assert any(c.verdict == "dangerous" and c.keys == (("model", "model"),) for c in both.candidates) and all(("power", "amount") not in c.keys for c in both.candidates)
    assert found["clients", "weather"].advice == "none" and found["clients", "weather"].verdict == "none"
    with pytest.raises(PreparationError):
        assembly.discover({str(k): clients for k in range(9)})


def test_many_to_many_is_never_safe(spark):
    i = F.col("id")
    a, b = spark.range(6).select((i / 2).cast("int").alias("k")), spark.range(60).select((i / 2 + 2).cast("int").alias("k"))
    got = assembly.relate(a, b, (("k", "k"),))
    assert (got.cardinality, got.verdict, got.estimated) == ("N:M", "weak", 4)
    assert assembly.relate(a, b.filter("k > 9"), (("k", "k"),)) is None
