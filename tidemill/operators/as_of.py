"""As-of joins that bear a key with a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.expressions import quoted

SLICES = 64


def as_of_join(left: DataFrame, right: DataFrame, by: str | list[str], on: str, value: str, into: str, slices: int = SLICES) -> DataFrame:
    """Each left row with ``into``: the ``value`` of the latest right row of the same
    ``by`` with ``on`` not after it; null if there is none, or if that value is null.
    Of right rows at one time the largest value counts. A null key or time meets
    nothing.

    Time is cut into slices at quantiles of the left times, and one shuffle deals rows
    by (key, slice), so one key is spread over as many tasks as there are slices. What
    a slice inherits is the last right row of the slices before it: one row for each
    key and slice that left rows have, carried along the slices of the key."""
    keys = [by] if isinstance(by, str) else list(by)
    whole = None
    for c in [*keys, on]:
        whole = quoted(c).isNotNull() if whole is None else whole & quoted(c).isNotNull()
    k = [f"k{i}" for i in range(len(keys))]
    named = [quoted(c).alias(n) for c, n in zip(keys, k)]
    cuts = left.filter(whole).select(F.percentile_approx(quoted(on), F.array(*(F.lit(i / slices) for i in range(1, slices))), 10_000).alias("c")).first()["c"] if slices > 1 else None
    edges = sorted(set(cuts or ()))
    time = left.schema[on].dataType
    number = reduce(lambda a, b: a + b, [(F.col("t") >= F.lit(e).cast(time)).cast("int") for e in edges], F.lit(0))
    kind = right.schema[value].dataType
    latest = right.filter(whole).select(*named, quoted(on).alias("t"), quoted(value).alias("v")).groupBy(*k, "t").agg(F.struct(F.max("v").alias("v")).alias("v"))
    rows = left.filter(whole).select(*named, quoted(on).alias("t"), F.struct(*(quoted(c) for c in left.columns)).alias("row"))
    ends = latest.groupBy(*k, number.alias("slice")).agg(F.max_by("v", "t").alias("v")).withColumn("asked", F.lit(False))
    asked = rows.select(*k, number.alias("slice")).distinct().withColumn("v", F.lit(None).cast(latest.schema["v"].dataType)).withColumn("asked", F.lit(True))
    # A key has at most two rows a slice here. What a slice holds itself comes after what it inherits.
    earlier = Window.partitionBy(*k).orderBy("slice", F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.unionByName(asked).withColumn("before", F.last("v", ignorenulls=True).over(earlier)).filter("asked and before is not null").select(*k, "slice", F.col("before").alias("v"))
    nothing = F.lit(None).cast(rows.schema["row"].dataType)
    never = F.lit(None).cast(time)
    all_rows = (
        rows.select(*k, F.lit(None).cast("int").alias("slice"), "t", F.lit(2).alias("side"), F.lit(None).cast(latest.schema["v"].dataType).alias("v"), "row")
        .union(latest.select(*k, F.lit(None).cast("int").alias("slice"), "t", F.lit(1).alias("side"), "v", nothing.alias("row")))
        .union(inherited.select(*k, "slice", never.alias("t"), F.lit(0).alias("side"), "v", nothing.alias("row")))
        .withColumn("slice", F.coalesce("slice", number))
    )
    so_far = Window.partitionBy(*k, "slice").orderBy(F.asc_nulls_first("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    met = all_rows.withColumn("v", F.last("v", ignorenulls=True).over(so_far)).filter("side = 2").select("row.*", F.col("v.v").alias(into))
    return met.unionByName(left.filter(~whole).withColumn(into, F.lit(None).cast(kind)))
