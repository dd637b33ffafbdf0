"""Data-quality checks. A finding carries a row predicate, and its count and the
rows shown come from that same predicate.

One wide aggregate per batch of columns finds the facts, one grouped pass counts the
values of all columns, and all outliers take one more aggregate: the number of scans
grows with neither columns nor values (identifiers that repeat are counted one by one).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import FLOATING, as_text, number, quoted, strip, truthy
from tidemill.functions.staging import staged
from tidemill.operators.ranked import percentiles
from tidemill.operators.rows import ORDER
from tidemill.operators.steps import Step

# Thresholds of the checks.
MIN_ROWS, NEAR_CONSTANT, HIGH_SHARE, HIGH_UNIQUE = 20, 0.99, 0.5, 100
IDENTIFIER, IQR_TIMES, MINORITY = 0.999, 1.5, 0.2
BATCH, CASE_UNIQUE, FILTER_VALUES = 100, 50_000, 200
CANONICAL_LIMIT = 40
SEVERITIES = ("problem", "warning", "notice")


@dataclass(frozen=True)
class RowFilter:
    kind: str
    columns: tuple[str, ...] = ()
    values: tuple[Any, ...] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    columns: tuple[str, ...]
    affected: int | None
    share: float | None
    rows: RowFilter | None = None
    counts: dict[str, float] = field(default_factory=dict)

    @property
    def finding_id(self) -> str:
        return hashlib.sha256("|".join((self.code, *self.columns)).encode()).hexdigest()[:16]


def _nan_or_inf(c: Column) -> Column:
    return truthy(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def row_predicate(schema: T.StructType, rows: RowFilter) -> Column:
    """The condition of every filter kind but ``duplicated_by`` and ``case_variants``."""
    if rows.kind in ("duplicated_by", "case_variants"):
        raise PreparationError(f"{rows.kind} needs the whole frame; use affected_rows")
    name = rows.columns[0]
    c, kind = quoted(name), schema[name].dataType
    text = c.cast("string")
    if rows.kind == "is_null":
        return c.isNull()
    if rows.kind == "is_empty_string":
        return truthy(F.length(text) == 0)
    if rows.kind == "is_nan_or_inf":
        return _nan_or_inf(c)
    if rows.kind == "not_equals":
        return ~c.eqNullSafe(F.lit(rows.values[0]).cast(kind))
    if rows.kind == "in_values":
        return truthy(c.isin(*rows.values))
    if rows.kind == "normalised_in_values":
        return truthy(F.lower(strip(text)).isin(*rows.values))
    if rows.kind == "has_surrounding_whitespace":
        return truthy(text != strip(text))
    if rows.kind == "out_of_range":
        outside = (c < rows.low) | (c > rows.high)
        return truthy(outside & ~_nan_or_inf(c) if isinstance(kind, FLOATING) else outside)
    if rows.kind == "not_parseable_as_number":
        return c.isNotNull() & number(strip(text)).isNull()
    raise PreparationError(f"there is no row filter {rows.kind!r}")


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(k0, k1, ..., n)`` of the key values that several rows share; nulls and NaNs
    are equal to themselves, and -0.0 to 0.0."""
    return df.groupBy(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keys))).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _keys(df: DataFrame, rows: RowFilter) -> list[str]:
    return list(rows.columns) or [c for c in df.columns if c != ORDER]


def _several(df: DataFrame, column: str) -> DataFrame:
    """``(normal, forms, rows)`` of the normal spellings that have several forms."""
    spelled = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(F.lower(strip(F.col("spelling"))).alias("normal")).agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows")).filter("forms > 1")


def affected_rows(df: DataFrame, rows: RowFilter) -> DataFrame:
    """The rows that a filter describes. Repeats and spellings are found by grouping
    with map-side counts and a join back (one Spark may split), not by a window, so one
    key with a third of the rows does not land in one task."""
    if rows.kind == "duplicated_by":
        keys = _keys(df, rows)
        repeated = _repeated(df, keys)
        same = [quoted(c).eqNullSafe(repeated[f"k{i}"]) for i, c in enumerate(keys)]
        return df.join(repeated, same, "left_semi")
    if rows.kind == "case_variants":
        several = _several(df, rows.columns[0])
        return df.join(several, F.lower(strip(quoted(rows.columns[0]))) == several["normal"], "left_semi")
    return df.filter(row_predicate(df.schema, rows))


def count_affected(df: DataFrame, rows: RowFilter) -> int:
    if rows.kind == "duplicated_by":
        return _repeated(df, _keys(df, rows)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if rows.kind == "case_variants":
        return _several(df, rows.columns[0]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return df.filter(row_predicate(df.schema, rows)).count()


def _plain(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if f.name != ORDER and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def column_facts(df: DataFrame) -> tuple[int, dict[str, dict]]:
    """Rows, and for each plain column: nulls, filled, unique, and by type empty,
    padded, odd (NaN or infinite), words (not numbers), quartiles; of columns with few
    values ``top`` (the most frequent and its count), of texts ``variants`` (normal
    spellings with several forms, their number and rows).

    One wide aggregate a batch of columns, and one grouped pass over the values of all
    columns, whose counts give the rest. All figures are exact."""
    fields, facts, total = _plain(df), {}, 0
    for at in range(0, max(len(fields), 1), BATCH):
        parts = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(fields[at : at + BATCH]):
            c = quoted(f.name)
            parts.append(F.count(c).alias(f"filled_{i}"))
            if isinstance(f.dataType, T.StringType):
                for name, kind in (("empty", "is_empty_string"), ("padded", "has_surrounding_whitespace"), ("words", "not_parseable_as_number")):
                    parts.append(F.count(F.when(row_predicate(df.schema, RowFilter(kind, (f.name,))), 1)).alias(f"{name}_{i}"))
            if isinstance(f.dataType, FLOATING):
                parts.append(F.count(F.when(_nan_or_inf(c), 1)).alias(f"odd_{i}"))
        row = df.agg(*parts).first().asDict()
        total = row.pop("rows")
        for i, f in enumerate(fields[at : at + BATCH]):
            mine = {k.rpartition("_")[0]: v for k, v in row.items() if k.endswith(f"_{i}") and k.rpartition("_")[2] == str(i)}
            facts[f.name] = mine | {"nulls": total - mine["filled"], "unique": 0, "type": f.dataType}
    if total and fields:
        _value_facts(df, fields, facts)
    return total, facts


def _value_facts(df: DataFrame, fields: list[T.StructField], facts: dict[str, dict]) -> None:
    cells = F.inline(F.array(*(F.struct(F.lit(f.name).alias("column"), as_text(f).alias("value")) for f in fields)))
    counted = staged(df.select(cells).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.max(F.struct("n", "value")).alias("top")).collect():
        mine = facts[r["column"]]
        mine["unique"] = r["unique"]
        if 2 <= r["unique"] <= FILTER_VALUES and not isinstance(mine["type"], T.BinaryType):
            mine["top"] = r["top"]["value"], r["top"]["n"]
    numbers = [n for n, f in facts.items() if isinstance(f["type"], T.NumericType)]
    if numbers:
        value = F.col("value").cast("double")
        values = counted.filter(F.col("column").isin(numbers)).select("column", value.alias("value"), "n").filter(~_nan_or_inf(F.col("value")))
        for r in percentiles(values, [0.25, 0.75], nearest_rank=True).groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():
            facts[r["column"]]["quartiles"] = r["low"], r["high"]
    texts = [n for n, f in facts.items() if isinstance(f["type"], T.StringType) and 1 < f["unique"] <= CASE_UNIQUE]
    if texts:
        groups = counted.filter(F.col("column").isin(texts)).groupBy("column", F.lower(strip(F.col("value"))).alias("normal")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        # At most CASE_UNIQUE groups of a column; names are shown only where there are few.
        for r in groups.groupBy("column").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).collect():
            few = r["groups"] <= FILTER_VALUES
            shown = groups.filter(F.col("column") == r["column"]).orderBy(F.desc("n"), "normal").limit(FILTER_VALUES).collect() if few else []
            facts[r["column"]]["variants"] = tuple(x["normal"] for x in shown), r["groups"], r["rows"]


def case_variants(df: DataFrame, column: str) -> DataFrame:
    """``(normal, spelling, n)`` of values that differ in case or outer spaces only."""
    spelled = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n")).withColumn("normal", F.lower(strip(F.col("spelling"))))
    several = spelled.groupBy("normal").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("normal")
    return spelled.join(several, "normal").select("normal", "spelling", "n")


def canonical_spellings(df: DataFrame, column: str) -> DataFrame:
    """``(spelling, canonical)``: each variant and the most frequent one of its
    group (ties to the smaller text)."""
    v = case_variants(df, column)
    best = v.groupBy("normal").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling")).alias("best")).select("normal", F.col("best.spelling").alias("canonical"))
    return v.join(best, "normal").filter("spelling != canonical").select("spelling", "canonical")


def _outlier_facts(df: DataFrame, total: int, facts: dict[str, dict]) -> None:
    """Adds ``reach`` and ``outside``, the filter and its rows, for all numeric columns."""
    asked = []
    for i, (name, f) in enumerate(facts.items()):
        if f.get("quartiles") and total >= MIN_ROWS:
            low, high = map(float, f["quartiles"])
            if high > low:
                f["reach"] = RowFilter("out_of_range", (name,), (), low - IQR_TIMES * (high - low), high + IQR_TIMES * (high - low))
                asked.append((name, F.count(F.when(row_predicate(df.schema, f["reach"]), 1)).alias(f"o{i}")))
    for at in range(0, len(asked), BATCH):
        for (name, _), n in zip(asked[at : at + BATCH], df.agg(*(c for _, c in asked[at : at + BATCH])).first()):
            facts[name]["outside"] = n


def _typed(value: str, kind: T.DataType) -> Any:
    if isinstance(kind, T.IntegralType):
        return int(value)
    return float(value) if isinstance(kind, FLOATING) else value == "true" if isinstance(kind, T.BooleanType) else value


def analyse(df: DataFrame) -> list[Finding]:
    """All findings, the gravest first; none for an empty frame."""
    total, facts = column_facts(df)
    if not total:
        return []
    _outlier_facts(df, total, facts)
    found: list[Finding] = []
    repeats = count_affected(df, RowFilter("duplicated_by"))
    if repeats:
        found.append(Finding("duplicate_rows", "warning", (), repeats, repeats / total, RowFilter("duplicated_by")))
    for name, f in facts.items():
        found += _column_findings(df, name, f, total, bool(repeats))
    return sorted(found, key=lambda x: (SEVERITIES.index(x.severity), -(x.affected or 0), x.code, x.columns))


def _column_findings(df: DataFrame, name: str, f: dict, total: int, repeats: bool) -> list[Finding]:
    out: list[Finding] = []

    def say(code: str, severity: str, n: int | None, rows: RowFilter | None = None, **counts: float) -> None:
        out.append(Finding(code, severity, (name,), n, None if n is None else n / total, rows, counts))

    def rows(kind: str, **more) -> RowFilter:
        return RowFilter(kind, (name,), **more)

    text = isinstance(f["type"], T.StringType)
    nulls, filled, unique = f["nulls"], f["filled"], f["unique"]
    if nulls == total:
        say("all_null_column", "problem", total, rows("is_null"))
    elif nulls:
        say("missing_values", "warning", nulls, rows("is_null"))
    if f.get("odd"):
        say("nan_or_infinity", "warning", f["odd"], rows("is_nan_or_inf"))
    if text and f["padded"]:
        say("whitespace_anomaly", "warning", f["padded"], rows("has_surrounding_whitespace"))
    if text and f["empty"] and nulls:
        say("empty_string_vs_null", "notice", f["empty"], rows("is_empty_string"), nulls=nulls)
    if text and filled and 0 < f["words"] < filled and f["words"] / filled <= MINORITY:
        say("mixed_semantic_types", "warning", f["words"], rows("not_parseable_as_number"), filled=filled)
    if "variants" in f:
        shown, groups, n = f["variants"]
        # With many groups the filter is the grouping itself, so that it shows what is counted.
        say("case_variant_categories", "warning", n, rows("normalised_in_values", values=shown) if shown else rows("case_variants"), groups=groups)
    if total < MIN_ROWS or not filled:
        return out
    share = unique / filled
    if unique == 1:
        say("constant_column", "notice", None)
        return out
    if not nulls and share >= IDENTIFIER:
        say("potential_identifier", "notice", None, unique=unique)
        if repeats and unique < filled:
            say("duplicate_keys", "warning", count_affected(df, rows("duplicated_by")), rows("duplicated_by"))
    elif text and share >= HIGH_SHARE and unique >= HIGH_UNIQUE:
        say("high_cardinality", "notice", None, unique=unique)
    if "top" in f and f["top"][1] / total >= NEAR_CONSTANT:
        value, n = f["top"]
        say("near_constant_column", "notice", total - n, rows("not_equals", values=(_typed(value, f["type"]),)), dominant=n)
    if f.get("outside"):
        say("outlier_values", "notice", f["outside"], f["reach"], low=f["reach"].low, high=f["reach"].high)
    return out


# ---------------------------------------------------------------- repair


@dataclass(frozen=True)
class Repair:
    title: str
    safety: str  # safe, decision or lossy
    steps: tuple[Step, ...]


def repairs(df: DataFrame, finding: Finding) -> list[Repair]:
    """What can be done about a finding, as pipeline steps."""
    names = list(finding.columns)
    column = names[0] if names else ""
    code = finding.code
    if code == "whitespace_anomaly":
        return [Repair("trim", "safe", (Step("trim_whitespace", {"columns": names}),))]
    if code == "empty_string_vs_null":
        return [Repair("empty to null", "safe", (Step("normalize_nulls", {"columns": names, "tokens": [""]}),))]
    if code in ("all_null_column", "constant_column", "near_constant_column"):
        return [Repair("drop the column", "decision", (Step("drop_columns", {"columns": names}),))]
    if code in ("duplicate_rows", "duplicate_keys"):
        return [Repair("keep the first of each", "lossy", (Step("deduplicate", {"columns": names} if names else {}),))]
    if code == "mixed_semantic_types":
        return [Repair("marks to null, then numbers", "lossy", (Step("normalize_nulls", {"columns": names}), Step("parse_number", {"column": column})))]
    if code == "case_variant_categories":
        out = [Repair("lower case", "decision", (Step("change_case", {"columns": names, "mode": "lower"}),))]
        pairs = canonical_spellings(df, column).orderBy("spelling").limit(CANONICAL_LIMIT + 1).collect()
        if 0 < len(pairs) <= CANONICAL_LIMIT:
            out.insert(0, Repair("most frequent spelling", "safe", tuple(Step("replace_values", {"column": column, "value": p["spelling"], "to": p["canonical"]}) for p in pairs)))
        return out
    if code == "missing_values":
        kind = df.schema[column].dataType
        if isinstance(kind, T.NumericType):
            fill = df.agg(F.median(quoted(column))).first()[0]
            fill = round(fill) if fill is not None and isinstance(kind, T.IntegralType) else fill
        else:
            top = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).count().orderBy(F.desc("count"), "v").first()
            fill = top["v"] if top else None
        drop = Repair("drop the rows", "lossy", (Step("drop_rows", {"column": column, "operator": "is_null"}),))
        return ([Repair("fill", "decision", (Step("fill_missing", {"column": column, "value": str(fill)}),))] if fill is not None else []) + [drop]
    return []


def changed_values(before: DataFrame, after: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent (before, after, n) of one column, for frames that both
    carry the order column."""
    a = before.select(ORDER, quoted(column).cast("string").alias("before"))
    b = after.select(ORDER, quoted(column).cast("string").alias("after"))
    return a.join(b, ORDER).filter(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "before", "after").limit(k)
