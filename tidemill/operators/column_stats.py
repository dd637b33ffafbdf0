"""Column profiles: numeric summary, distinct count, top values, histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import as_text, finite, quoted
from tidemill.functions.staging import staged
from tidemill.operators.ranked import percentiles, value_counts
from tidemill.operators.rows import ORDER, with_order

TOP, BINS, EXAMPLES = 10, 20, 5


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, distinct (null counts as a value), min, max, mean,
    median, std (sample), q1, q3 with linear interpolation; NaN counts as the largest.

    Values are counted, and the percentiles picked by running totals over ranges of
    the counts (``ranked``): exact, with no buffer that grows with the values."""
    c = quoted(column)
    moments = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    counted = staged(value_counts(df, {"v": c}))
    picked = percentiles(counted, [0.25, 0.5, 0.75])
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("value")))
    spread = picked.agg(at(0.5).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    # Three tables of one row each.
    one = moments.join(F.broadcast(counted.agg(F.count(F.lit(1)).alias("values")))).join(F.broadcast(spread))
    return one.select("rows", "nulls", (F.col("values") + F.when(F.col("nulls") > 0, 1).otherwise(0)).alias("distinct"), "min", "max", "mean", "median", "std", "q1", "q3")


def top_values(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k most frequent non-null values, their counts and shares of the
    non-null rows; ties go to the smaller text."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise PreparationError(f"column {column!r} of type {kind.simpleString()} has no top values")
    counted = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("ratio")).orderBy(F.desc("count"), "value").limit(k)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal bins over the finite range, the last one closed; a constant column
    gives one bin. Two passes: the range (one row), then a map-side count."""
    kind = df.schema[column].dataType
    value = finite(quoted(column), kind).cast("double")
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    slot = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    counted = df.select(value.alias("v")).filter("v is not null").crossJoin(F.broadcast(span)).groupBy(slot.alias("bin"), "low", "high").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (F.col("low") + F.col("bin") * width).alias("start"), F.when(F.col("bin") == bins - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width).alias("end"), "count")


def examples(df: DataFrame, column: str, k: int = EXAMPLES) -> DataFrame:
    """The first k non-null values in source order."""
    return with_order(df).filter(quoted(column).isNotNull()).orderBy(ORDER).limit(k).select(quoted(column))


def distinct_facts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``(column, unique, filled, least)``: distinct values, rows that have one, and the
    rows of the rarest; all columns in one grouped pass."""
    cells = F.inline(F.array(*(F.struct(F.lit(f.name).alias("column"), as_text(f).alias("value")) for f in fields)))
    counted = df.select(cells).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("filled"), F.min("n").alias("least"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row for each plain column: rows, missing, unique, constant, and min,
    max, mean of the finite values of numeric ones. One aggregate and one grouped pass."""
    plain = [f for f in df.schema if f.name != ORDER and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    schema = "column string, rows long, missing long, unique long, constant boolean, min double, max double, mean double"
    if not plain:
        return df.sparkSession.createDataFrame([], schema)
    parts = []
    for i, f in enumerate(plain):
        c = quoted(f.name)
        v = finite(c, f.dataType).cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        parts += [F.count(F.when(c.isNull(), 1)).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"m{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    each = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.col("rows"), F.col(f"n{i}").alias("missing"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"m{i}").alias("mean")) for i, f in enumerate(plain)]
    # One row a column on either side.
    told = row.select(F.inline(F.array(*each))).join(distinct_facts(df, plain).select("column", "unique"), "column", "left")
    unique = F.coalesce("unique", F.lit(0))
    return told.orderBy("place").select("column", "rows", "missing", unique.alias("unique"), (unique <= 1).alias("constant"), "min", "max", "mean")
