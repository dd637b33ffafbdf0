"""Order statistics over any number of distinct values.

Values are counted first. The counts are range-partitioned by value, each range is
summed, and the running total over the ranges (one row each) is added to the running
totals inside them: no task holds more than one range, and none all values. A rank is
then a row whose running total reaches it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.expressions import quoted
from tidemill.functions.staging import staged

PART = "__range__"


def running_total(counted: DataFrame, order: list[Column], n: str = "n", into: str = "upto") -> DataFrame:
    """``counted`` with the total of ``n`` over all rows up to and with each one, in
    the order of ``order`` (which tells all rows apart)."""
    placed = staged(counted.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))
    sizes = placed.groupBy(PART).agg(F.sum(n).alias("__size__"))
    # One row a range.
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(PART, F.coalesce(F.sum("__size__").over(earlier), F.lit(0)).alias("__start__"))
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(starts), PART).withColumn(into, F.sum(n).over(within) + F.col("__start__")).drop(PART, "__start__")


def value_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(column, value, n)`` of the doubles ``values``, all columns in one pass;
    nulls are left out, and -0.0 is 0.0."""
    cells = F.inline(F.array(*(F.struct(F.lit(name).alias("column"), v.cast("double").alias("value")) for name, v in values.items())))
    plain = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    return df.select(cells).filter("value is not null").groupBy("column", plain.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(counted: DataFrame, fractions: list[float], nearest_rank: bool = False) -> DataFrame:
    """``(column, fraction, value)`` from ``(column, value, n)``: exact percentiles
    with linear interpolation between ranks, or by nearest rank (the smallest value
    that so large a share of the rows does not exceed). NaN counts as the largest."""
    ranked = running_total(counted, [F.col("column"), F.col("value")])
    # One row a column.
    span = ranked.groupBy("column").agg(F.sum("n").alias("rows"), F.min(F.col("upto") - F.col("n")).alias("base"))
    wanted = []
    for f in fractions:
        if nearest_rank:
            place = F.greatest(F.ceil(F.lit(f) * F.col("rows")), F.lit(1)) - 1
            wanted.append(F.struct(F.lit(f).alias("fraction"), place.cast("long").alias("low"), place.cast("long").alias("high"), F.lit(0.0).alias("share")))
        else:
            place = F.lit(f) * (F.col("rows") - 1)
            wanted.append(F.struct(F.lit(f).alias("fraction"), F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("share")))
    asked = span.select("column", "base", F.array(*wanted).alias("asked"))
    holds = lambda place: (F.col("upto") - F.col("n") - F.col("base") <= place) & (place < F.col("upto") - F.col("base"))
    hits = ranked.join(F.broadcast(asked), "column").select("column", "value", F.explode(F.transform("asked", lambda a: F.struct(a["fraction"].alias("fraction"), a["share"].alias("share"), holds(a["low"]).alias("low"), holds(a["high"]).alias("high")))).alias("a")).filter("a.low or a.high")
    ends = hits.groupBy("column", "a.fraction", "a.share").agg(F.max(F.when(F.col("a.low"), F.col("value"))).alias("low"), F.max(F.when(F.col("a.high"), F.col("value"))).alias("high"))
    return ends.select("column", "fraction", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value"))


def competition_ranks(df: DataFrame, score: str, into: str = "rank") -> DataFrame:
    """``df`` with ranks 1, 1, 3 of ``score``, the largest first; a null score has no
    rank. Scores are counted, so many equal ones are one row."""
    counted = df.filter(quoted(score).isNotNull()).groupBy(quoted(score).alias("__score__")).agg(F.count(F.lit(1)).alias("n"))
    places = running_total(counted, [F.desc("__score__")]).select("__score__", (F.col("upto") - F.col("n") + 1).alias(into))
    return df.join(places, quoted(score) == F.col("__score__"), "left").drop("__score__")


def median(df: DataFrame, column: Column) -> float | None:
    row = percentiles(value_counts(df, {"v": column}), [0.5]).first()
    return None if row is None or row["value"] is None or math.isnan(row["value"]) else row["value"]
