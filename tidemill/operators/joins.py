"""Joins: key types, layout, exact forecast, key suggestions, execution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import FLOATING, INTEGRAL, NUMERIC, quoted
from tidemill.operators.rows import ORDER, with_order

KINDS = ("inner", "left", "right", "full")
UNIQUE_ENOUGH, EXPLOSION = 0.999, 2
MAX_PAIRS, MIN_OVERLAP, MAX_SUGGESTIONS = 400, 0.05, 10


@dataclass(frozen=True)
class JoinSpec:
    """``keys`` are (left, right) names; selections None keep all columns."""

    keys: tuple[tuple[str, str], ...]
    kind: str = "inner"
    suffix: str = "_2"
    left_columns: tuple[str, ...] | None = None
    right_columns: tuple[str, ...] | None = None


def key_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The common type of two key columns; None if they cannot be compared."""
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return T.StringType()
    if isinstance(left, INTEGRAL) and isinstance(right, INTEGRAL):
        return T.LongType()
    if isinstance(left, NUMERIC) and isinstance(right, NUMERIC):
        return T.DecimalType(38, 0) if not isinstance(left, FLOATING) and not isinstance(right, FLOATING) and getattr(left, "scale", 0) == getattr(right, "scale", 0) == 0 else T.DoubleType()
    return left if left == right and not isinstance(left, (T.ArrayType, T.MapType, T.StructType)) else None


def _keys(left: DataFrame, right: DataFrame, spec: JoinSpec) -> tuple[list[Column], list[Column]]:
    if spec.kind not in KINDS:
        raise PreparationError(f"there is no join kind {spec.kind!r}")
    if not spec.keys:
        raise PreparationError("a join needs a key")
    ours, theirs = [], []
    for a, b in spec.keys:
        if a not in left.columns or b not in right.columns:
            raise PreparationError(f"there is no key {a!r} = {b!r}")
        kind = key_type(left.schema[a].dataType, right.schema[b].dataType)
        if kind is None:
            raise PreparationError(f"{a!r} ({left.schema[a].dataType.simpleString()}) and {b!r} ({right.schema[b].dataType.simpleString()}) cannot be compared")
        ours.append(quoted(a).cast(kind))
        theirs.append(quoted(b).cast(kind))
    return ours, theirs


def layout(left: DataFrame, right: DataFrame, spec: JoinSpec) -> list[tuple[str, str, str]]:
    """(side, source name, result name) of each result column. Inner and left joins
    keep the left keys, right joins the right ones, full joins both."""
    if not spec.suffix:
        raise PreparationError("the suffix must not be empty")
    lk, rk = [a for a, _ in spec.keys], [b for _, b in spec.keys]

    def chosen(df: DataFrame, keys: list[str], picked: tuple[str, ...] | None) -> list[str]:
        if picked is not None and (missing := [c for c in picked if c not in df.columns]):
            raise PreparationError(f"there is no column {missing[0]!r}")
        return [c for c in df.columns if c != ORDER and (picked is None or c in picked or c in keys)]

    ours, theirs = chosen(left, lk, spec.left_columns), chosen(right, rk, spec.right_columns)
    if spec.kind in ("inner", "left"):
        theirs = [c for c in theirs if c not in rk]
    elif spec.kind == "right":
        ours = [c for c in ours if c not in lk]
    taken = {c.lower() for c in ours}
    out = [("left", c, c) for c in ours]
    for c in theirs:
        name = c if c.lower() not in taken else c + spec.suffix
        if name != c and (name.lower() in taken or name.lower() in {x.lower() for x in theirs}):
            raise PreparationError(f"the name {name!r} is taken; choose another suffix")
        taken.add(name.lower())
        out.append(("right", c, name))
    return out


def join(left: DataFrame, right: DataFrame, spec: JoinSpec, in_order: bool = False) -> DataFrame:
    """The equi-join; null keys meet nothing. With ``in_order`` rows come in left,
    then right source order (a range exchange; off by default)."""
    columns = layout(left, right, spec)
    ours, theirs = _keys(left, right, spec)
    l = (with_order(left) if in_order else left).select(*(k.alias(f"__k{i}__") for i, k in enumerate(ours)), *(quoted(c).alias(f"__l_{c}") for c in left.columns), *([quoted(ORDER).alias("__lo__")] if in_order and ORDER not in left.columns else []))
    r = (with_order(right) if in_order else right).select(*(k.alias(f"__j{i}__") for i, k in enumerate(theirs)), *(quoted(c).alias(f"__r_{c}") for c in right.columns), *([quoted(ORDER).alias("__ro__")] if in_order and ORDER not in right.columns else []))
    on = [F.col(f"__k{i}__") == F.col(f"__j{i}__") for i in range(len(ours))]
    out = l.join(r, on, "full_outer" if spec.kind == "full" else spec.kind)
    if in_order:
        out = out.orderBy(F.col("__lo__").asc_nulls_last(), F.col("__ro__").asc_nulls_last())
    return out.select(*(quoted(f"__{'l' if side == 'left' else 'r'}_{c}").alias(name) for side, c, name in columns))


def forecast(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row: left_rows, right_rows, common_keys, inner_rows, matched rows of both
    sides, and the exact number of rows the join will have.

    Each side is grouped by key with map-side counts, then only the groups are
    joined, so a hot key is one row and the join itself never runs."""
    ours, theirs = _keys(left, right, spec)
    names = [f"k{i}" for i in range(len(ours))]
    l = left.select(*(k.alias(n) for k, n in zip(ours, names))).groupBy(*names).agg(F.count(F.lit(1)).alias("l"))
    r = right.select(*(k.alias(n) for k, n in zip(theirs, names))).groupBy(*names).agg(F.count(F.lit(1)).alias("r"))
    met = l.join(r, names).agg(F.count(F.lit(1)).alias("common_keys"), F.coalesce(F.sum(F.col("l").cast("decimal(38,0)") * F.col("r")), F.lit(0)).cast("bigint").alias("inner_rows"), F.coalesce(F.sum("l"), F.lit(0)).alias("matched_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("matched_right"))
    sides = l.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows")).crossJoin(r.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows")))
    loose_left, loose_right = F.col("left_rows") - F.col("matched_left"), F.col("right_rows") - F.col("matched_right")
    rows = {"inner": F.col("inner_rows"), "left": F.col("inner_rows") + loose_left, "right": F.col("inner_rows") + loose_right, "full": F.col("inner_rows") + loose_left + loose_right}[spec.kind]
    return sides.crossJoin(met).select("left_rows", "right_rows", "common_keys", "inner_rows", "matched_left", "matched_right", rows.alias("estimated_rows"))


def key_analysis(left: DataFrame, right: DataFrame, spec: JoinSpec) -> list[dict]:
    """For each key pair: nulls and unique ratio of both sides, common values."""
    out = []
    for a, b in spec.keys:
        one = JoinSpec(((a, b),))
        ours, theirs = _keys(left, right, one)

        def side(df: DataFrame, key: Column):
            row = df.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
            return {"rows": row[0], "nulls": row[0] - row[1], "unique_ratio": row[2] / row[1] if row[1] else 0.0}

        out.append({"left": a, "right": b, "left_side": side(left, ours[0]), "right_side": side(right, theirs[0]), "common": forecast(left, right, one).first()["common_keys"]})
    return out


def cardinality(keys: list[dict]) -> str:
    one = all(k["left_side"]["unique_ratio"] >= UNIQUE_ENOUGH for k in keys)
    other = all(k["right_side"]["unique_ratio"] >= UNIQUE_ENOUGH for k in keys)
    return "1:1" if one and other else "1:N" if one else "N:1" if other else "N:M"


def warnings(keys: list[dict], relation: str, estimated: int, left_rows: int, right_rows: int) -> list[str]:
    out = [f"{k['left']} = {k['right']}: {k['left_side']['nulls']} and {k['right_side']['nulls']} rows have no key and meet nothing" for k in keys if k["left_side"]["nulls"] or k["right_side"]["nulls"]]
    if estimated > EXPLOSION * max(left_rows, right_rows, 1):
        out.append(f"the result has {estimated} rows, more than either side ({left_rows}, {right_rows}); a {relation} relation multiplies rows")
    if estimated == 0:
        out.append("no rows meet; the result is empty")
    return out


def suggest_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Likely key pairs: left, right, overlap_share, left_unique, right_unique,
    relation, confidence; the ten best.

    All comparable columns of a side become one long (column, value) frame of
    distinct texts, so that every pair is counted by a single join on the value.
    All values count; the join sees each once a column."""

    def family(kind: T.DataType) -> str | None:
        return "n" if isinstance(kind, NUMERIC) else "s" if isinstance(kind, T.StringType) else None

    pairs = [(a.name, b.name) for a in left.schema for b in right.schema if family(a.dataType) and family(a.dataType) == family(b.dataType)][:MAX_PAIRS]
    spark = left.sparkSession
    schema = "left string, right string, overlap_share double, left_unique double, right_unique double, relation string, confidence double"
    if not pairs:
        return spark.createDataFrame([], schema)

    def side(df: DataFrame, names: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
        cells = df.select(F.inline(F.array(*(F.struct(F.lit(n).alias(tag), quoted(n).cast("string").alias("value")) for n in names)))).filter("value is not null")
        counted = cells.groupBy(tag, "value").agg(F.count(F.lit(1)).alias("n"))
        unique = counted.groupBy(tag).agg((F.count(F.lit(1)) / F.sum("n")).alias(f"{tag}_unique"))
        return counted.select(tag, "value"), unique

    ours, lu = side(left, sorted({a for a, _ in pairs}), "left")
    theirs, ru = side(right, sorted({b for _, b in pairs}), "right")
    sizes = ours.groupBy("left").agg(F.count(F.lit(1)).alias("nl")).crossJoin(theirs.groupBy("right").agg(F.count(F.lit(1)).alias("nr")))
    common = ours.join(theirs, "value").groupBy("left", "right").agg(F.count(F.lit(1)).alias("common"))
    allowed = spark.createDataFrame(pairs, "left string, right string")
    told = common.join(sizes, ["left", "right"]).join(allowed, ["left", "right"]).join(lu, "left").join(ru, "right").withColumn("overlap_share", F.col("common") / F.least("nl", "nr")).filter(F.col("overlap_share") >= MIN_OVERLAP)
    one, other = F.col("left_unique") >= UNIQUE_ENOUGH, F.col("right_unique") >= UNIQUE_ENOUGH
    relation = F.when(one & other, "1:1").when(one, "1:N").when(other, "N:1").otherwise("N:M")
    confidence = F.least(F.lit(1.0), 0.6 * F.col("overlap_share") + F.when(F.lower("left") == F.lower("right"), 0.2).otherwise(0.0) + F.when(one | other, 0.2).otherwise(0.0))
    return told.select("left", "right", "overlap_share", "left_unique", "right_unique", relation.alias("relation"), confidence.alias("confidence")).orderBy(F.desc("confidence"), "left", "right").limit(MAX_SUGGESTIONS)
