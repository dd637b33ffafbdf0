"""Robust decisions: constraints, then states, the Pareto front, TOPSIS on it, and how
far the choice bears other weights and noise in the measurements.

Random draws are functions of (seed, sample, row, criterion), so they are the same
under any partitioning; scenarios are bounded by their parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.functions.expressions import quoted
from tidemill.functions.staging import staged
from tidemill.operators.decision import CONDITIONAL, STABLE, dirichlet, scaled_distances, shares_of, topsis, unit_weights
from tidemill.operators.skyline import complete, dominated

MAX_CRITERIA, MAX_SAMPLES = 30, 20_000
#: Least and largest step of a weight grid.
GRID = 0.001, 0.25
#: Rows times samples of noise that a task draws, twice.
TASK_DRAWS = 1_000_000


@dataclass(frozen=True)
class Constraint:
    criterion: str
    op: str
    bound: float

    @property
    def text(self) -> str:
        return f"{self.criterion} {self.op} {self.bound:g}"

    def holds(self) -> Column:
        """Null where the criterion was not measured."""
        c = quoted(self.criterion).cast("double")
        c = F.when(~F.isnan(c), c)
        return c <= self.bound if self.op == "<=" else c >= self.bound


def validate(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float], constraints: list[Constraint] | None = None) -> None:
    """Refuse a problem that has no sensible answer."""
    if not criteria or len(criteria) > MAX_CRITERIA:
        raise PreparationError(f"a decision takes 1 to {MAX_CRITERIA} criteria")
    for name in [key, *criteria, *(c.criterion for c in constraints or ())]:
        if name not in df.columns:
            raise PreparationError(f"there is no column {name!r}")
    if set(criteria.values()) - {"max", "min"}:
        raise PreparationError("a criterion is to be max or min")
    if any(not math.isfinite(weights.get(c, 0)) or weights.get(c, 0) < 0 for c in criteria) or sum(weights.get(c, 0) for c in criteria) <= 0:
        raise PreparationError("weights must be finite, at least 0 and not all 0")
    for c in constraints or ():
        if c.op not in ("<=", ">=") or not math.isfinite(c.bound):
            raise PreparationError("a constraint is <= or >= a finite bound")
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(quoted(key).isNull(), 1)).alias("nulls")).first()
    if facts["n"] < 2:
        raise PreparationError("a choice needs two alternatives at least")
    if facts["nulls"] or not df.groupBy(quoted(key)).count().filter("count > 1").isEmpty():
        raise PreparationError("keys of alternatives must be there and differ")


def states(df: DataFrame, key: str, criteria: dict[str, str], constraints: list[Constraint]) -> DataFrame:
    """``df`` with ``status`` and what led to it: ``missing`` criteria (incomplete),
    ``violated`` constraints (infeasible), constraints that cannot be checked
    (``unverified``); else feasible. The first that applies counts."""
    known = lambda c: F.coalesce(quoted(c).isNotNull() & (F.abs(quoted(c).cast("double")) < F.lit(float("inf"))), F.lit(False))
    listed = lambda pairs: F.filter(F.array(*(F.when(w, F.lit(t)) for t, w in pairs)), lambda x: x.isNotNull()) if pairs else F.array().cast("array<string>")
    out = df.withColumn("missing", listed([(c, ~known(c)) for c in criteria]))
    out = out.withColumn("violated", listed([(c.text, c.holds() == F.lit(False)) for c in constraints])).withColumn("unverified", listed([(c.text, c.holds().isNull()) for c in constraints]))
    return out.withColumn("status", F.when(F.size("missing") > 0, "incomplete").when(F.size("violated") > 0, "infeasible").when(F.size("unverified") > 0, "unverified").otherwise("feasible"))


def robust_ranking(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float], constraints: list[Constraint] | None = None, normalization: str = "vector") -> DataFrame:
    """``(key, status, missing, violated, unverified, dominated_by, closeness, d_plus,
    d_minus, rank)`` of every alternative.

    Criteria of weight 0 take part in constraints only. Feasible rows are ``pareto`` or
    ``dominated`` (with the least key of the front that dominates them); those of the
    front are ranked by TOPSIS among themselves, all others have no rank."""
    scored = {c: way for c, way in criteria.items() if weights.get(c, 0) > 0}
    validate(df, key, scored, weights, constraints)
    found = staged(states(df, key, scored, list(constraints or [])))
    feasible = found.filter("status = 'feasible'")
    by = dominated(feasible, key, scored)
    front = feasible.join(by.filter("dominated_by is null").select(F.col(key).alias("__front__")), quoted(key) == F.col("__front__"), "left_semi")
    ranked = topsis(staged(front), key, scored, weights, normalization)
    by = by.select(F.col(key).alias("__by__"), "dominated_by")
    ranked = ranked.withColumnRenamed(key, "__ranked__")
    out = found.join(by, quoted(key) == F.col("__by__"), "left").join(ranked, quoted(key) == F.col("__ranked__"), "left")
    status = F.when(F.col("__by__").isNull(), F.col("status")).when(F.col("dominated_by").isNull(), "pareto").otherwise("dominated")
    return out.select(quoted(key), status.alias("status"), "missing", "violated", "unverified", "dominated_by", "closeness", "d_plus", "d_minus", "rank")


def weight_intervals(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float], step: float = 0.01, normalization: str = "vector") -> DataFrame:
    """``(criterion, current, segment, start, end, winner, holds)``: which alternative
    wins while one weight goes over a grid from 0 to 1 and the others share the rest in
    their proportions. Equal winners in a row are a segment; ``holds`` marks the one
    around the current weight, whose ends bound the choice.

    Every alternative meets a number of scenarios fixed by the grid; the rest is one
    row a scenario. Ties go to the smaller key. Incomplete rows take no part."""
    if not GRID[0] <= step <= GRID[1]:
        raise PreparationError(f"the step of a weight grid lies between {GRID[0]} and {GRID[1]}")
    w, points, names = unit_weights({c: weights[c] for c in criteria}), round(1 / step), list(criteria)
    # One point a row: the criterion's place, and the grid point or the current weight.
    grid = []
    for j, c in enumerate(names):
        ts = {0.0, 1.0} if w[c] >= 1 else {k / points for k in range(points + 1)} | {w[c]}
        for t in sorted(ts):
            scenario = [t if k == j else (w[n] * (1 - t) / (1 - w[c]) if w[c] < 1 else 0.0) for k, n in enumerate(names)]
            if w[c] >= 1:
                scenario = [w[n] for n in names]  # the only weight: nothing to share out
            if sum(scenario) > 0:
                grid.append((len(grid), c, w[c], t, *(x / sum(scenario) for x in scenario)))
    scenarios = df.sparkSession.createDataFrame(grid, "s int, criterion string, current double, t double, " + ", ".join(f"w_{i} double" for i in range(len(names))))
    ways = [criteria[c] for c in names]
    rows = scaled_distances(df.filter(complete(criteria)), key, names, ways, normalization)
    met = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).join(F.broadcast(scenarios), "s")
    score = F.round(shares_of([F.col(f"w_{i}") for i in range(len(names))], names), 12)
    won = met.select("s", F.struct((-score).alias("score"), F.col("__key__").alias("key")).alias("entry")).groupBy("s").agg(F.min("entry").alias("best"))
    winners = won.join(F.broadcast(scenarios.select("s", "criterion", "current", "t")), "s").select("criterion", "current", "t", F.col("best.key").alias("winner"))
    along = Window.partitionBy("criterion").orderBy("t")
    islands = winners.withColumn("new", F.coalesce((F.lag("winner").over(along) != F.col("winner")).cast("int"), F.lit(1))).withColumn("segment", F.sum("new").over(along))
    segments = islands.groupBy("criterion", "current", "segment", "winner").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return segments.select("criterion", "current", F.col("segment").cast("int").alias("segment"), "start", "end", "winner", ((F.col("start") <= F.col("current")) & (F.col("current") <= F.col("end"))).alias("holds"))


def _hex(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def _uniform(hexed: Column, at: int) -> Column:
    """A uniform draw in (0, 1) from 13 hex digits."""
    return (F.conv(F.substring(hexed, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal_draw(*parts) -> Column:
    """A standard normal draw that depends on ``parts`` alone."""
    h = _hex(*parts)
    return F.sqrt(-2 * F.log(_uniform(h, 1))) * F.cos(2 * math.pi * _uniform(h, 14))


def _winners(scored: DataFrame, samples: int, name: str) -> DataFrame:
    """``(key, share)`` of the samples that each row wins; ties share a sample."""
    best = scored.groupBy("s").agg(F.max("score").alias("score"))
    won = scored.join(best, ["s", "score"])
    ties = won.groupBy("s").agg(F.count(F.lit(1)).alias("__ties__"))
    return won.join(ties, "s").groupBy(F.col("__key__").alias(name)).agg((F.sum(1 / F.col("__ties__")) / samples).alias("share"))


def weight_shares(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float] | None = None, concentration: float | None = None, samples: int = 2000, seed: int = 42, normalization: str = "vector") -> DataFrame:
    """``(key, share)``: how often each alternative is first under random weights:
    uniform ones, or with ``concentration`` spread around ``weights``. Only rows that
    win a sample are listed; incomplete ones take no part."""
    if not 0 < samples <= MAX_SAMPLES:
        raise PreparationError(f"a share takes 1 to {MAX_SAMPLES} samples")
    names, spark = list(criteria), df.sparkSession
    if concentration is None:
        # Normalised exponentials are uniform weights.
        drawn = spark.range(samples).select(F.col("id").cast("int").alias("s"), *((-F.log(_uniform(_hex(seed, F.col("id"), c), 1))).alias(f"e_{i}") for i, c in enumerate(names)))
        total = sum((F.col(f"e_{i}") for i in range(1, len(names))), F.col("e_0"))
        scenarios = drawn.select("s", *((F.col(f"e_{i}") / total).alias(f"w_{i}") for i in range(len(names))))
    else:
        if concentration <= 0 or weights is None:
            raise PreparationError("a concentration is positive and needs weights")
        w = unit_weights({c: weights[c] for c in names})
        draws = dirichlet(samples, [max(concentration * w[c], 1e-3) for c in names], seed)
        scenarios = spark.createDataFrame([(i, *x) for i, x in enumerate(draws)], "s int, " + ", ".join(f"w_{i} double" for i in range(len(names))))
    rows = scaled_distances(df.filter(complete(criteria)), key, names, [criteria[c] for c in names], normalization)
    met = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).join(F.broadcast(scenarios), "s")
    return _winners(met.select("s", "__key__", F.round(shares_of([F.col(f"w_{i}") for i in range(len(names))], names), 12).alias("score")), samples, key)


def noise_shares(df: DataFrame, key: str, criteria: dict[str, str], stds: dict[str, str], weights: dict[str, float], samples: int = 2000, seed: int = 44) -> DataFrame:
    """``(key, share)``: how often each alternative is first if every value is drawn
    anew around itself with its own deviation (column ``stds[criterion]``; a missing
    one counts as exact). Vector normalisation is of each sample's own values.

    Rows stay as they are and meet their samples inside tasks: one pass finds each
    sample's norms and ends, another the rows that lead a batch, and only those are
    ranked together. A task holds one sample of one batch."""
    if not 0 < samples <= MAX_SAMPLES:
        raise PreparationError(f"a share takes 1 to {MAX_SAMPLES} samples")
    names, w = list(criteria), unit_weights({c: weights[c] for c in criteria})
    rows = df.filter(complete(criteria)).select(quoted(key).alias("__key__"), quoted(key).cast("string").alias("__text__"), *(quoted(c).cast("double").alias(f"v_{i}") for i, c in enumerate(names)), *((F.coalesce(quoted(stds[c]).cast("double"), F.lit(0.0)) if c in stds else F.lit(0.0)).alias(f"d_{i}") for i, c in enumerate(names)))
    rows = staged(rows)
    rows = rows.repartition(max(1, -(-rows.count() * samples // TASK_DRAWS)))
    kind, k = rows.schema["__key__"].dataType.simpleString(), len(names)

    def spans(batches):
        """Of each sample, over the rows of a task: squared length, least and largest value."""
        sums, low, high = np.zeros((samples, k)), np.full((samples, k), np.nan), np.full((samples, k), -np.inf)
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                for s, x in enumerate(_noisy(batch, names, samples, seed)):
                    sums[s] += (x * x).sum(axis=1)
                    low[s], high[s] = np.fmin(low[s], np.fmin.reduce(x, axis=1)), np.maximum(high[s], x.max(axis=1))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples, dtype=np.int32)), *(pa.array(np.ascontiguousarray(y[:, i])) for i in range(k) for y in (sums, low, high))], names=["s", *(f"{n}_{i}" for i in range(k) for n in "nab")])

    facts = rows.mapInArrow(spans, "s int, " + ", ".join(f"n_{i} double, a_{i} double, b_{i} double" for i in range(k)))
    # One row a sample, MAX_SAMPLES at most.
    facts = facts.groupBy("s").agg(*(f(F.col(f"{n}_{i}")).alias(f"{n}_{i}") for i in range(k) for n, f in (("n", lambda x: F.sqrt(F.sum(x))), ("a", F.min), ("b", F.max))))
    table = np.array([r[1:] for r in sorted(facts.collect())]).reshape(-1, k, 3)
    n, least, most = table[:, :, 0], table[:, :, 1], table[:, :, 2]
    up = np.array([criteria[c] == "max" for c in names])
    best, worst, share = np.where(up, most, least), np.where(up, least, most), np.array([w[c] for c in names])

    def leaders(batches):
        """The rows of a batch that no other one beats in a sample, by more than rounding may hide."""
        for batch in batches:
            for s, x in enumerate(_noisy(batch, names, samples, seed) if batch.num_rows else ()):
                plus, minus = np.zeros(x.shape[1]), np.zeros(x.shape[1])
                with np.errstate(invalid="ignore", divide="ignore"):
                    for i in range(k):
                        if n[s, i] != 0:
                            plus += ((x[i] - best[s, i]) / n[s, i] * share[i]) ** 2
                            minus += ((x[i] - worst[s, i]) / n[s, i] * share[i]) ** 2
                    p, m = np.sqrt(plus), np.sqrt(minus)
                    score = np.where(p + m == 0, 0.5, m / (p + m))
                odd = np.isnan(score)  # above all numbers, as in Spark
                lead = np.flatnonzero(odd if odd.any() else score >= score.max() - 1e-11)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), s, np.int32)), batch.column(0).take(pa.array(lead)), pa.array(score[lead])], names=["s", "__key__", "score"])

    scored = staged(rows.mapInArrow(leaders, f"s int, __key__ {kind}, score double").withColumn("score", F.round("score", 12)))
    return _winners(scored, samples, key)


def _noisy(batch: pa.RecordBatch, names: list[str], samples: int, seed: int) -> Iterator[np.ndarray]:
    """For each sample the values (criteria x rows) of ``batch``, drawn as ``normal_draw`` does."""
    column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()
    fixed, spread = (np.array([column(f"{x}_{i}") for i in range(len(names))]) for x in "vd")
    texts = [b"" if t is None else b":" + t.encode() for t in batch.column(1).to_pylist()]
    drawn = [np.flatnonzero(~(d <= 0)) for d in spread]
    tails = [[texts[j] + f":{c}".encode() for j in rows] for c, rows in zip(names, drawn)]
    for s in range(samples):
        start, x = f"{seed}:{s}".encode(), fixed.copy()
        for i, rows in enumerate(drawn):
            if len(rows):
                high, low = np.frombuffer(b"".join([md5(start + t).digest() for t in tails[i]]), ">u8").reshape(-1, 2).T.astype(np.uint64)
                # The first 13 hex digits, and the next 13.
                u = ((high >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
                v = (((high & np.uint64(0xFFF)) << np.uint64(40) | low >> np.uint64(24)).astype(float) + 0.5) / float(1 << 52)
                x[i, rows] += spread[i, rows] * (np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v))
        yield x


def influence(df: DataFrame, criteria: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """``(criterion, declared, influence)``: each criterion's share of the weighted,
    vector-normalised spans, beside the weight that it was given."""
    w = unit_weights({c: weights[c] for c in criteria})
    spans = [F.coalesce((F.max(quoted(c).cast("double")) - F.min(quoted(c).cast("double"))) / F.nullif(F.sqrt(F.sum(F.pow(quoted(c).cast("double"), F.lit(2)))), F.lit(0.0)), F.lit(0.0)) * w[c] for c in criteria]
    row = df.filter(complete(criteria)).agg(*(s.alias(f"s{i}") for i, s in enumerate(spans)))
    total = sum((F.col(f"s{i}") for i in range(1, len(spans))), F.col("s0"))
    each = [F.struct(F.lit(c).alias("criterion"), F.lit(w[c]).alias("declared"), F.coalesce(F.col(f"s{i}") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("influence")) for i, c in enumerate(criteria)]
    return row.select(F.inline(F.array(*each)))


def recommendation(df: DataFrame, key: str, criteria: dict[str, str], weights: dict[str, float], constraints: list[Constraint] | None = None, stds: dict[str, str] | None = None, concentration: float = 50.0, samples: int = 2000, seed: int = 42) -> DataFrame:
    """One row: ``winner``, ``feasible``, ``front``, ``local_share``, ``noise_share``
    and ``verdict``: none (nothing is feasible), stable, conditional or unstable by the
    weaker of the winner's shares; a front of one row is stable."""
    ranked = staged(robust_ranking(df, key, criteria, weights, constraints))
    scored = {c: way for c, way in criteria.items() if weights.get(c, 0) > 0}
    best = ranked.filter("rank = 1").agg(F.min(quoted(key)).alias("winner"))
    counts = ranked.agg(F.count(F.when(F.col("status").isin("pareto", "dominated"), 1)).alias("feasible"), F.count(F.when(F.col("status") == "pareto", 1)).alias("front"))
    front = staged(df.join(ranked.filter("status = 'pareto'").select(quoted(key)), key, "left_semi"))
    local = weight_shares(front, key, scored, weights, concentration, samples, seed).withColumnRenamed("share", "local_share")
    out = best.join(counts).join(local, F.col("winner") == local[key], "left").drop(key)
    if stds:
        noise = noise_shares(front, key, scored, stds, weights, samples, seed + 2).withColumnRenamed("share", "noise_share")
        out = out.join(noise, F.col("winner") == noise[key], "left").drop(key)
        out = out.withColumn("noise_share", F.when(F.col("winner").isNotNull(), F.coalesce("noise_share", F.lit(0.0))))
    else:
        out = out.withColumn("noise_share", F.lit(None).cast("double"))
    out = out.withColumn("local_share", F.when(F.col("winner").isNotNull(), F.coalesce("local_share", F.lit(0.0))))
    weakest = F.least("local_share", "noise_share")
    said = F.when(F.col("front") == 0, "none").when(F.col("front") == 1, "stable").when(weakest >= STABLE, "stable").when(weakest >= CONDITIONAL, "conditional").otherwise("unstable")
    return out.select("winner", "feasible", "front", "local_share", "noise_share", said.alias("verdict"))
