"""Assembling a modelling table: column roles, targets, leaks, purposes, and how
datasets relate. Figures are of whole tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import FLOATING, TEMPORAL, quoted
from tidemill.functions.staging import staged
from tidemill.operators.column_stats import distinct_facts
from tidemill.operators.joins import UNIQUE_ENOUGH, JoinSpec, forecast, key_type, suggest_keys
from tidemill.operators.rows import ORDER

# Limits and name hints of the rules.
MIN_CLASSES, MAX_CLASSES, ROOT, LEAK, TARGETS = 2, 20, 6, 0.98, 6
MAX_DATASETS, MAX_KEYS, MAX_COMPOSITE, MAX_TRIES, CANDIDATES = 8, 3, 3, 12, 5
IDENTIFIER, HINTED_IDENTIFIER, FEW_TEXTS, WEAK_MATCH, RARE, MIN_ROWS = 0.95, 0.5, 50, 0.1, 0.05, 200
TARGET_HINTS = re.compile(
    r"(price|цен|cost|стоим|amount|сумм|revenue|выручк|income|доход|sales|продаж|target|label|класс|class|"
    r"status|статус|churn|отток|default|дефолт|fraud|accident|авари|outcome|result|итог|score|rating|оценк)",
    re.IGNORECASE,
)
ID_HINTS = re.compile(r"(^id$|_id$|^id_|\bid\b|номер|^no$|_no$|code$|код|uuid|phone|телефон|email)", re.IGNORECASE)


def _fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if f.name != ORDER and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def _role(kind: str, hinted: Column) -> Column:
    unique, rows = F.col("unique"), F.col("rows")
    ratio = unique / F.greatest(rows - F.col("missing"), F.lit(1))
    out = F.when(unique <= 1, "constant")
    if kind in ("datetime", "boolean"):
        return out.otherwise(kind)
    out = out.when((ratio >= IDENTIFIER) & (rows > MAX_CLASSES) | hinted & (ratio > HINTED_IDENTIFIER), "identifier")
    if kind == "number":
        return out.otherwise(F.when(unique > MAX_CLASSES, "numeric").otherwise("categorical"))
    return out.otherwise(F.when(unique <= F.greatest(F.lit(FEW_TEXTS), F.floor(rows / 20)), "categorical").otherwise("text"))


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, unique, missing, least, rows, role)``: constant, datetime, boolean,
    identifier (nearly all values differ, or the name says so and most do), numeric,
    categorical (numbers of few values, too) or text."""
    fields = _fields(df)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, unique long, missing long, least long, rows long, role string")
    kinds = {f.name: "datetime" if isinstance(f.dataType, TEMPORAL) else "boolean" if isinstance(f.dataType, T.BooleanType) else "number" if isinstance(f.dataType, T.NumericType) else "text" for f in fields}
    # One row a column on either side.
    names = df.sparkSession.createDataFrame([(i, n, k, bool(ID_HINTS.search(n))) for i, (n, k) in enumerate(kinds.items())], "place int, column string, kind string, hinted boolean")
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    facts = names.join(distinct_facts(df, fields), "column", "left").join(F.broadcast(total))
    facts = facts.withColumn("unique", F.coalesce("unique", F.lit(0))).withColumn("missing", F.col("rows") - F.coalesce("filled", F.lit(0)))
    role = None
    for kind in ("datetime", "boolean", "number", "text"):
        one = F.col("kind") == kind
        role = F.when(one, _role(kind, F.col("hinted"))) if role is None else role.when(one, _role(kind, F.col("hinted")))
    return facts.orderBy("place").select("column", "unique", "missing", F.coalesce("least", F.lit(0)).alias("least"), "rows", role.alias("role"))


@dataclass(frozen=True)
class Target:
    column: str
    task: str
    classes: int | None
    minority: float | None
    missing: float
    hinted: bool
    #: (column, why): "name" or the correlation.
    leaks: tuple[tuple[str, str | float], ...]
    warnings: tuple[str, ...]
    rank_score: float


def _root(name: str) -> str:
    return re.sub(r"[^a-zа-я]", "", name.lower())[:ROOT]


def _correlations(df: DataFrame, targets: list[str], numeric: list[str]) -> dict[tuple[str, str], float]:
    """Of pairs with more than ten rows that have both, all in one aggregate."""
    pairs = [(t, c) for t in targets for c in numeric if t != c]
    if not pairs:
        return {}
    parts = []
    for i, (t, c) in enumerate(pairs):
        x, y = quoted(t).cast("double"), quoted(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        parts += [F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    row = df.agg(*parts).first()
    return {p: row[f"r{i}"] for i, p in enumerate(pairs) if row[f"n{i}"] > 10 and row[f"r{i}"] is not None and row[f"r{i}"] == row[f"r{i}"]}


def leakage_suspects(df: DataFrame, target: str, roles: list | None = None) -> tuple[tuple[str, str | float], ...]:
    """Columns whose name shares the target's root, or that follow a numeric target
    almost exactly."""
    roles = roles or column_roles(df).collect()
    number = isinstance(df.schema[target].dataType, T.NumericType)
    found = _correlations(df, [target] if number else [], [r["column"] for r in roles if r["role"] == "numeric"])
    return _leaks(target, roles, found)


def _leaks(target: str, roles: list, correlations: dict) -> tuple[tuple[str, str | float], ...]:
    root, out = _root(target), []
    for r in roles:
        c = r["column"]
        if c == target:
            continue
        if len(root) >= 3 and root in _root(c):
            out.append((c, "name"))
        elif abs(correlations.get((target, c), 0.0)) >= LEAK:
            out.append((c, round(correlations[target, c], 3)))
    return tuple(out)


def target_candidates(df: DataFrame) -> list[Target]:
    """Columns that a model could predict, TARGETS at most, in the order of their rank
    score: a telling name raises it, missing values and a rare class lower it."""
    roles = column_roles(df).collect()
    picked = []
    for r in roles:
        rows, filled = r["rows"], r["rows"] - r["missing"]
        if r["role"] in ("identifier", "constant", "text", "datetime") or not rows or r["missing"] / rows > 0.5:
            continue
        if r["role"] in ("categorical", "boolean"):
            if MIN_CLASSES <= r["unique"] <= MAX_CLASSES:
                picked.append((r, "classification", round(r["least"] / filled, 4)))
        else:
            picked.append((r, "regression", None))
    numbers = [r["column"] for r, *_ in picked if isinstance(df.schema[r["column"]].dataType, T.NumericType)]
    correlations = _correlations(df, numbers, [r["column"] for r in roles if r["role"] == "numeric"])
    out = []
    for r, task, minority in picked:
        missing, hinted, rare = round(r["missing"] / r["rows"], 4), bool(TARGET_HINTS.search(r["column"])), minority is not None and minority < RARE
        said = []
        if missing:
            said.append(f"{missing:.0%} of the rows have no value and cannot be learned from")
        if rare:
            said.append(f"the rarest class has {minority:.1%} of the rows: stratify, and measure what imbalance does not hide")
        if r["rows"] < MIN_ROWS:
            said.append(f"{r['rows']} rows are few to learn and test on")
        score = round((0.5 if hinted else 0.0) + (0.3 if task == "regression" else 0.25) - missing - (0.2 if rare else 0.0), 3)
        out.append(Target(r["column"], task, r["unique"] if task == "classification" else None, minority, missing, hinted, _leaks(r["column"], roles, correlations), tuple(said), score))
    return sorted(out, key=lambda x: -x.rank_score)[:TARGETS]


def purposes(df: DataFrame) -> list[str]:
    """What a table may serve: analytics, classification, regression, forecasting,
    clustering; learning asks for MIN_ROWS rows."""
    rows = column_roles(df).collect()
    roles = [r["role"] for r in rows]
    enough = bool(rows) and rows[0]["rows"] >= MIN_ROWS
    tasks = {t.task for t in target_candidates(df)}
    numeric, dims = roles.count("numeric"), roles.count("categorical") + roles.count("boolean")
    told = (("analytics", dims and numeric), ("classification", "classification" in tasks and enough), ("regression", "regression" in tasks and enough), ("forecasting", "datetime" in roles and numeric), ("clustering", numeric >= 2 and enough))
    return [name for name, ok in told if ok]


# ---------------------------------------------------------------- relations


@dataclass(frozen=True)
class Candidate:
    keys: tuple[tuple[str, str], ...]
    cardinality: str
    estimated: int
    match_share: float
    verdict: str  # safe, weak or dangerous
    confidence: float | None


@dataclass(frozen=True)
class Relation:
    left: str
    right: str
    candidates: tuple[Candidate, ...]
    advice: str  # join, aggregate, review or none

    @property
    def verdict(self) -> str:
        return self.candidates[0].verdict if self.candidates else "none"

    @property
    def keys(self) -> tuple[tuple[str, str], ...]:
        return self.candidates[0].keys if self.candidates else ()


def _unique_share(df: DataFrame, keys: list[str]) -> float:
    """Distinct keys against rows that have one; composite keys as a whole."""
    whole = df.select(*(quoted(k).alias(f"k{i}") for i, k in enumerate(keys))).na.drop("any")
    row = whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
    return row["d"] / row["n"] if row["n"] else 0.0


def relate(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...], confidence: float | None = None) -> Candidate | None:
    """What an inner join by ``keys`` would do; None if no rows meet. Many to many is
    never safe: dangerous if rows multiply, else weak; so is a match of few rows."""
    f = forecast(left, right, JoinSpec(keys)).first()
    if not f["estimated_rows"]:
        return None
    one, other = (_unique_share(df, [k[i] for k in keys]) >= UNIQUE_ENOUGH for i, df in enumerate((left, right)))
    kind = "1:1" if one and other else "1:N" if one else "N:1" if other else "N:M"
    ours, theirs = f["matched_left"] / max(f["left_rows"], 1), f["matched_right"] / max(f["right_rows"], 1)
    if kind == "N:M":
        verdict = "dangerous" if f["estimated_rows"] > max(f["left_rows"], f["right_rows"]) else "weak"
    else:
        verdict = "weak" if max(ours, theirs) < WEAK_MATCH else "safe"
    return Candidate(keys, kind, f["estimated_rows"], round(min(ours, theirs), 4), verdict, confidence)


def _same_name(a: str, b: str) -> bool:
    plain = lambda x: re.sub(r"[^a-zа-я0-9]", "", x.lower())
    return plain(a) == plain(b)


def relation(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> Relation:
    """How two tables may be joined: the best single keys, and, where one multiplies
    rows, composite keys with columns of the same name, those of most values first.

    Fractions are measurements and no keys, unless both columns have one name."""
    kinds = lambda a, b: (left.schema[a].dataType, right.schema[b].dataType)
    plausible = lambda a, b: not all(isinstance(k, FLOATING) for k in kinds(a, b)) or _same_name(a, b)
    found = [((r["left"], r["right"]), r["confidence"]) for r in suggest_keys(left, right).collect() if plausible(r["left"], r["right"])][:MAX_KEYS]
    candidates = [c for k, confidence in found if (c := relate(left, right, (k,), round(confidence, 3)))]
    bad = [c for c in candidates if c.verdict == "dangerous"]
    if bad:
        shared = [(a, b) for a in left.columns for b in right.columns if ORDER not in (a, b) and _same_name(a, b) and key_type(*kinds(a, b)) is not None]
        fields = [f for f in _fields(left) if f.name in {a for a, _ in shared}]
        spread = {r["column"]: r["unique"] for r in distinct_facts(left, fields).collect()} if fields else {}
        tries, seen = 0, {c.keys for c in candidates}
        for base in bad:
            extra = sorted((p for p in shared if p != base.keys[0]), key=lambda p: -spread.get(p[0], 0))
            for combo in (c for n in range(1, MAX_COMPOSITE) for c in combinations(extra, n)):
                if tries >= MAX_TRIES:
                    break
                tries += 1
                keys = (*base.keys, *combo)
                if keys not in seen:
                    seen.add(keys)
                    made = relate(left, right, keys)
                    if made and made.estimated < base.estimated:
                        candidates.append(made)
    candidates.sort(key=lambda c: (("safe", "weak", "dangerous").index(c.verdict), -c.match_share, c.estimated))
    if not candidates:
        advice = "none"
    elif candidates[0].verdict == "safe":
        advice = "join"
    else:
        advice = "aggregate" if any(c.cardinality == "N:M" for c in candidates) else "review"
    return Relation(*names, tuple(candidates[:CANDIDATES]), advice)


def discover(tables: dict[str, DataFrame]) -> list[Relation]:
    """Relations of all pairs of at most MAX_DATASETS tables; each table is staged once."""
    if len(tables) > MAX_DATASETS:
        raise PreparationError(f"{MAX_DATASETS} tables at most")
    kept = {name: staged(df) for name, df in tables.items()}
    return [relation(kept[a], kept[b], (a, b)) for a, b in combinations(kept, 2)]
