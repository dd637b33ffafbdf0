"""Multi-criteria decisions over DataFrames: TOPSIS, the primary metric, utilities on
fixed scales. ``robust`` has constraints, the Pareto front and sensitivity."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.functions.expressions import quoted
from tidemill.operators.ranked import competition_ranks
from tidemill.operators.skyline import complete

TIE = 1e-12
STABLE, CONDITIONAL = 0.6, 0.3


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def unit_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise PreparationError("weights must be at least 0 and not all 0")
    return {c: w / total for c, w in weights.items()}


def scaled_distances(df: DataFrame, key: str, names: list[str], ways: list[str], normalization: str = "vector") -> DataFrame:
    """``(__key__, p_0, m_0, p_1, ...)``: how far each row lies from the best and from
    the worst value of each criterion, normalised and not yet weighted. Norms and
    ranges do not depend on the weights: one aggregate gives them all."""
    v = [quoted(c).cast("double") for c in names]
    facts = df.agg(*(F.sqrt(F.sum(x * x)).alias(f"n_{i}") for i, x in enumerate(v)), *(F.min(x).alias(f"a_{i}") for i, x in enumerate(v)), *(F.max(x).alias(f"b_{i}") for i, x in enumerate(v)))
    out = []
    for i, way in enumerate(ways):
        unit = F.col(f"n_{i}") if normalization == "vector" else F.col(f"b_{i}") - F.col(f"a_{i}")
        best, worst = (F.col(f"b_{i}"), F.col(f"a_{i}")) if way == "max" else (F.col(f"a_{i}"), F.col(f"b_{i}"))
        for side, end in (("p", best), ("m", worst)):
            out.append(F.coalesce((v[i] - end) / F.nullif(unit, F.lit(0.0)), F.lit(0.0)).alias(f"{side}_{i}"))
    # Facts are one row.
    return df.join(F.broadcast(facts)).select(quoted(key).alias("__key__"), *out)


def weighted_distance(side: str, weights: list[Column], names: list[str]) -> Column:
    return F.sqrt(_sum([F.pow(F.col(f"{side}_{i}") * weights[i], F.lit(2)) for i in range(len(names))]))


def shares_of(weights: list[Column], names: list[str]) -> Column:
    """Closeness from ``scaled_distances``; 0.5 where both distances are 0."""
    p, m = weighted_distance("p", weights, names), weighted_distance("m", weights, names)
    return F.when(p + m == 0, 0.5).otherwise(m / F.nullif(p + m, F.lit(0.0)))


def topsis(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float], normalization: str = "vector") -> DataFrame:
    """``(key, closeness, d_plus, d_minus, rank)`` of every row.

    Criteria map to ``max`` or ``min``. One aggregate gives the norms and ranges of
    all criteria, and closeness is then an expression of each row; closeness is 0.5
    where both distances are 0. Ranks are competition ranks (1, 1, 3) of closeness to
    twelve digits, from running totals over ranges of its values. Rows with a missing
    or infinite criterion do not count and have no closeness and no rank."""
    w, names = unit_weights({c: weights[c] for c in criteria}), list(criteria)
    shares = [F.lit(w[c]) for c in names]
    scored = scaled_distances(df.filter(complete(criteria)), key, names, list(criteria.values()), normalization)
    p, m = weighted_distance("p", shares, names), weighted_distance("m", shares, names)
    scored = scored.select("__key__", shares_of(shares, names).alias("closeness"), p.alias("d_plus"), m.alias("d_minus"))
    ranked = competition_ranks(scored.withColumn("__level__", F.round("closeness", 12)), "__level__").drop("__level__")
    rest = df.filter(~complete(criteria)).select(quoted(key).alias("__key__"), *(F.lit(None).cast("double").alias(c) for c in ("closeness", "d_plus", "d_minus")), F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("__key__", key)


def primary_metric(df: DataFrame, key: str, metric: str, way: str = "max", std: str | None = None) -> DataFrame:
    """The alternatives that cannot be told from the best: gap up to the largest
    std of the pair."""
    sign = 1 if way == "max" else -1
    best = df.orderBy((sign * quoted(metric)).desc_nulls_last(), quoted(key)).limit(1).select(quoted(metric).alias("__best__"), (quoted(std) if std else F.lit(0.0)).alias("__std__"))
    noise = F.greatest(F.coalesce(quoted(std), F.lit(0.0)), F.coalesce("__std__", F.lit(0.0))) if std else F.lit(0.0)
    return df.crossJoin(F.broadcast(best)).filter(F.abs(quoted(metric) - F.col("__best__")) <= noise).drop("__best__", "__std__")


def utility(value: Column, low: float, high: float, way: str = "max", scale: str = "linear") -> Column:
    """A fixed-scale utility from 0 to 1; values beyond the scale are clamped."""
    if high <= low or scale == "log" and low <= 0:
        raise PreparationError("a scale needs low < high, and low > 0 if logarithmic")
    x = F.greatest(F.least(value.cast("double"), F.lit(float(high))), F.lit(float(low)))
    share = (F.log(x) - math.log(low)) / (math.log(high) - math.log(low)) if scale == "log" else (x - low) / (high - low)
    return share if way == "max" else 1 - share


def fixed_scale_topsis(df: DataFrame, key: str, criteria: dict[str, tuple[float, float, str, str]], weights: dict[str, float]) -> DataFrame:
    """Closeness to the all-ones ideal on fixed utility scales
    ``{criterion: (low, high, way, scale)}``: adding rows changes no score."""
    w = unit_weights({c: weights[c] for c in criteria})
    u = {c: utility(quoted(c), *spec) for c, spec in criteria.items()}
    plus = F.sqrt(_sum([F.pow(F.lit(w[c]) * (1 - x), F.lit(2)) for c, x in u.items()]))
    minus = F.sqrt(_sum([F.pow(F.lit(w[c]) * x, F.lit(2)) for c, x in u.items()]))
    return df.select(quoted(key), F.when(plus + minus == 0, 0.5).otherwise(minus / F.nullif(plus + minus, F.lit(0.0))).alias("closeness"))


def dirichlet(n: int, alphas: list[float], seed: int) -> list[list[float]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        draw = [rng.gammavariate(a, 1.0) for a in alphas]
        total = sum(draw)
        out.append([x / total for x in draw] if total > 0 else [1 / len(alphas)] * len(alphas))
    return out


def verdict(share: float, front: int) -> str:
    return "stable" if front == 1 or share >= STABLE else "conditional" if share >= CONDITIONAL else "unstable"
