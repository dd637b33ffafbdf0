"""Mixing by soft membership: posteriors, then nonnegative rates that hit targets.

A naive Bayes classifier over hashed words, trained on the labelled table, gives
every document a probability for each domain; how sharp these are is set on labelled
rows held out. Documents then get rates r >= min_rate such that the expected domain
totals ``S_d = sum_i r_i * tokens_i * p_id`` come as close to the targets ``T`` as they
can, in least squares. Projected gradient descent takes ``r_i = max(min_rate,
y_i - p_i . W (S(y) - T))`` with y the rate plus momentum. The first steps have W the
inverse of ``H = sum_i tokens_i * p_i p_i'`` (the same optimum where targets can be
reached, in few steps); if a gap is left W is 1 / (largest eigenvalue of H), for plain
least squares, until the optimality conditions hold. S is linear, so each step needs
one aggregate with as many sums as domains. Only DataFrame functions touch the rows;
the driver sees the sums and the model, whose size is a parameter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, free_name

SPACES = " \t\n\x0b\f\r"
#: The domain of all documents where nothing is labelled.
ALL = "all"


@dataclass(frozen=True)
class MixRules:
    """``sample_docs`` labelled rows at most train the classifier (the smallest
    by hash of doc_id); all words count, hashed to ``buckets`` features."""

    sample_docs: int = 5000
    buckets: int = 4096
    smoothing: float = 0.5
    #: Steps in the metric of H, then plain ones; Fit tells whether they were enough. Plain
    #: steps end, too, where STALL of them lower the distance to the targets by less than PROGRESS.
    fast_steps: int = 15
    steps: int = 60
    #: Largest gap of a domain's total, or breach of an optimality condition, as a share of all tokens.
    tolerance: float = 1e-4


#: What the mean log odds of a document's words may be multiplied with.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
STALL, PROGRESS = 10, 0.01
#: Steps after which rates are written, so that expressions stay short.
WRITE_EVERY = 15


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    prior: tuple[float, ...]
    #: For each domain the log odds of each bucket.
    odds: tuple[tuple[float, ...], ...] = ()
    sharpness: float = 1.0
    #: Share of held-out labelled rows whose domain is predicted.
    accuracy: float | None = None


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for null or blank text."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(clean), "[\\x20\\x09-\\x0D]+"))


def _features(words: Column, buckets: int) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _mean_odds(features: Column, odds: tuple[float, ...]) -> Column:
    """Mean log odds of a document's features in one domain; the table is a literal."""
    table = F.split(F.lit(",".join(map(repr, odds))), ",").cast("array<double>")
    return F.aggregate(features, F.lit(0.0), lambda acc, b: acc + table[b]) / F.greatest(F.size(features), F.lit(1))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raw = [F.exp(s - top) for s in scores]
    return [x / _sum(raw) for x in raw]


def fit_domains(docs: DataFrame, labels: DataFrame, rules: MixRules, keep: Scratch) -> DomainModel:
    """A naive Bayes model from ``labels(doc_id, domain)``; a fifth of the labelled
    rows, by hash of doc_id, is held out to set its sharpness.

    A doc_id with several labels takes the smallest; nulls are left out."""
    known = labels.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample_docs)
    # sample_docs bounds what is broadcast: two small columns a row.
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    texts = keep.saved(texts.select("domain", held.alias("held"), _features(words_of(F.col("text")), rules.buckets).alias("features")), "labelled")
    sizes = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return DomainModel((ALL,), (0.0,))
    domains, total = sorted(sizes), sum(sizes.values())
    prior = tuple(math.log(sizes[d] / total) for d in domains)

    def odds(part: DataFrame) -> tuple[tuple[float, ...], ...]:
        """At most buckets x domains counts reach the driver."""
        table = [[0] * rules.buckets for _ in domains]
        for r in part.select("domain", F.explode("features").alias("b")).groupBy("domain", "b").count().collect():
            table[domains.index(r["domain"])][r["b"]] = r["count"]
        every = [sum(row) + rules.smoothing * rules.buckets for row in table]
        share = [[(x + rules.smoothing) / n for x in row] for row, n in zip(table, every)]
        mean = [sum(col) / len(col) for col in zip(*share)]
        return tuple(tuple(math.log(x / m) for x, m in zip(row, mean)) for row in share)

    first, tests = odds(texts.filter("not held")), texts.filter("held")
    means = tests.select("domain", *(_mean_odds(F.col("features"), first[i]).alias(f"o{i}") for i in range(len(domains))))
    means = keep.saved(means, "means")
    best, accuracy = 1.0, None
    if not means.isEmpty() and len(domains) > 1:
        asked = []
        for k, s in enumerate(SHARPNESS):
            p = _softmax([F.lit(prior[i]) + F.lit(s) * F.col(f"o{i}") for i in range(len(domains))])
            own = reduce(lambda rest, i: F.when(F.col("domain") == domains[i], p[i]).otherwise(rest), range(len(domains)), F.lit(0.0))
            asked += [F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias(f"loss{k}"), F.avg((own >= F.greatest(*p)).cast("double")).alias(f"right{k}")]
        got = means.agg(*asked).first()
        k = min(range(len(SHARPNESS)), key=lambda k: got[f"loss{k}"])
        best, accuracy = SHARPNESS[k], got[f"right{k}"]
    return DomainModel(tuple(domains), prior, odds(texts), best, accuracy)


def _with_posteriors(docs: DataFrame, model: DomainModel, rules: MixRules, tokens: str, posterior: str) -> DataFrame:
    """``docs`` with the token count and an array of probabilities, in the
    order of ``model.domains``."""
    words, features = free_name(docs, "words"), free_name(docs, "features")
    out = docs.withColumn(words, words_of(F.col("text")))
    scores = [F.lit(x) for x in model.prior]
    if model.odds:
        out = out.withColumn(features, _features(F.col(words), rules.buckets))
        scores = [p + F.lit(model.sharpness) * _mean_odds(F.col(features), odds) for p, odds in zip(scores, model.odds)]
    raw = free_name(docs, "score")
    out = out.select(*docs.columns, F.size(words).cast("long").alias(tokens), F.array(*scores).alias(raw))
    share = _softmax([F.col(raw)[i] for i in range(len(model.domains))])
    return out.select(*docs.columns, tokens, F.array(*share).alias(posterior))


def _inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Gauss elimination with pivoting; the matrix is as wide as there are domains."""
    n = len(matrix)
    rows = [[*map(float, m), *(float(i == j) for j in range(n))] for i, m in enumerate(matrix)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[k] = rows[k], rows[i]
        rows[i] = [a / rows[i][i] for a in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def _times(matrix: list[list[float]], x: list[float]) -> list[float]:
    return [sum(a * b for a, b in zip(row, x)) for row in matrix]


def _largest_eigenvalue(matrix: list[list[float]]) -> float:
    """By powers; its bound, the largest row sum, where they have not settled."""
    bound = max(sum(map(abs, row)) for row in matrix)
    x, value = [1.0] * len(matrix), 0.0
    for _ in range(200):
        y = _times(matrix, x)
        norm = math.sqrt(sum(v * v for v in y))
        if not norm:
            return bound
        x, before, value = [v / norm for v in y], value, norm / math.sqrt(sum(v * v for v in x))
        if abs(value - before) <= 1e-12 * value:
            return min(bound, value * (1 + 1e-6))
    return bound


#: Steps of the descent: momentum and W (S - T).
Steps = tuple[tuple[float, tuple[float, ...]], ...]


@dataclass(frozen=True)
class Fit:
    """The steps that make a document's rate from its posterior, and what the rates
    reach. ``gap`` is the largest of the domains'
    gaps, ``breach`` the largest breach of an optimality condition of the least
    squares (0 at the optimum), both as shares of all tokens."""

    steps: Steps
    target: tuple[float, ...]
    reached: tuple[float, ...]
    gap: float = 0.0
    breach: float = 0.0
    converged: bool = True

    def rate(self, posterior: Column, min_rate: float = 0.0) -> Column:
        return _stepped(posterior, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("last")), self.steps, min_rate)["rate"]


def _stepped(p: Column, state: Column, steps: Steps, lowest: float) -> Column:
    """``state(rate, last)`` after the steps."""
    if not steps:
        return state
    told = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.array(*(F.lit(float(x)) for x in g)).alias("g")) for m, g in steps))

    def step(s, x):
        y = s["rate"] + x["m"] * (s["rate"] - s["last"])
        return F.struct(F.greatest(F.lit(float(lowest)), y - _sum(p[i] * x["g"][i] for i in range(len(steps[0][1])))).alias("rate"), s["rate"].alias("last"))

    return F.aggregate(told, state, step)


def fit_rates(members: DataFrame, domains: tuple[str, ...], weights: dict[str, float], rules: MixRules, keep: Scratch, min_rate: float = 0.0, grow_only: bool = False) -> Fit:
    """Fit rates to ``members(tokens, posterior)``.

    ``weights`` share out the corpus's tokens as targets (a domain without a
    weight gets 0; all weights 0 leave the natural totals). With ``grow_only`` no
    target is below the domain's own total. Targets that no rates reach are met as
    nearly as least squares can; ``converged`` is false if the steps did not suffice."""
    d = range(len(domains))
    p, t = F.col("posterior"), F.col("tokens")
    state = members.select("tokens", "posterior", F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("last")).alias("s"))
    sums = members.agg(*(F.coalesce(F.sum(t * p[i]), F.lit(0.0)).alias(f"s{i}") for i in d), *(F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"h{i}_{j}") for i in d for j in d if i <= j)).first()
    natural = [sums[f"s{i}"] for i in d]
    total, mass = sum(natural), sum(weights.get(x, 0.0) for x in domains)
    if not total:
        return Fit((), tuple(0.0 for _ in d), tuple(0.0 for _ in d))
    target = [total * weights.get(x, 0.0) / mass for x in domains] if mass else list(natural)
    if grow_only:
        target = [max(a, b) for a, b in zip(target, natural)]
    h = [[sums[f"h{min(i, j)}_{max(i, j)}"] for j in d] for i in d]
    inverse = _inverse([[h[i][j] + 1e-9 * total * (i == j) for j in d] for i in d])
    plain = [[(i == j) / _largest_eigenvalue(h) for j in d] for i in d]

    def off(s: list[float]) -> list[float]:
        return [a - b for a, b in zip(s, target)]

    def gap(s: list[float]) -> float:
        return max(map(abs, off(s))) / total

    def breach(s: list[float]) -> float:
        """No document may gain from a larger rate, none above min_rate from a smaller one."""
        g = off(s)
        least = state.filter("tokens > 0").agg(F.min(_sum(p[i] * F.lit(g[i]) for i in d))).first()[0]
        slack = sum((a - min_rate * b) * x for a, b, x in zip(s, natural, g)) / max(sum(s), total)
        return max(0.0, -least, abs(slack)) / total

    taken: list = []  # all steps
    recent: list = []  # those since rates were last written
    metric, reached, last, momentum, best = inverse, natural, natural, 1.0, math.inf
    away: list[float] = []  # the distance after each plain step
    while gap(reached) > rules.tolerance and len(taken) < rules.steps:
        if len(taken) == rules.fast_steps:
            metric, momentum, last, best = plain, 1.0, reached, math.inf
        if metric is plain and not recent and breach(reached) <= rules.tolerance:
            break
        if len(away) > STALL and min(away[-STALL:]) > (1 - PROGRESS) * min(away[:-STALL]):
            break
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        m = (momentum - 1) / after
        step = m, tuple(_times(metric, off([a + m * (a - b) for a, b in zip(reached, last)])))
        taken.append(step)
        recent.append(step)
        rate = _stepped(p, F.col("s"), tuple(recent), min_rate)
        got = state.select("tokens", "posterior", rate["rate"].alias("rate")).agg(*(F.sum(F.col("rate") * t * p[i]).alias(f"s{i}") for i in d)).first()
        last, reached = reached, [got[f"s{i}"] for i in d]
        loss = sum(a * b for a, b in zip(_times(metric, off(reached)), off(reached)))
        if metric is plain:
            away.append(math.dist(reached, target))
        momentum, best = after if loss <= best else 1.0, loss  # momentum that overshot starts anew
        if len(recent) == WRITE_EVERY:
            state, recent = keep.saved(state.select("tokens", "posterior", rate.alias("s")), "rates", merge=False), []
    breached = 0.0 if gap(reached) <= rules.tolerance else breach(reached)
    return Fit(tuple(taken), tuple(target), tuple(reached), gap(reached), breached, breached <= rules.tolerance)


def label_domains(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` as domains: toxic, good or poor."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], rules: MixRules | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, domain (the likeliest, ties
    to the smaller name), p_max, rate (0 or more), expected_tokens, and of the whole
    fit, the same in all rows, gap (the largest of the domains' gaps to their targets,
    as a share of all tokens) and converged (whether no rates come nearer).

    A null or blank text has no tokens; its posterior is the share of the labels.
    Without labels all documents form one domain
    and keep rate 1. Repeated rows give repeated rows. Labels of unknown or null
    documents and other columns have no effect; an empty table gives no rows."""
    rules, keep = rules or MixRules(), Scratch(docs.sparkSession)
    model = fit_domains(docs, labels, rules, keep)
    members = keep.saved(_with_posteriors(docs.select("doc_id", "text"), model, rules, "tokens", "posterior").select("doc_id", "tokens", "posterior"), "members", merge=False)
    fit = fit_rates(members, model.domains, weights, rules, keep)
    keep.drop(but=("members",))
    top = F.array_max("posterior")
    name = F.array(*(F.lit(x) for x in model.domains))[F.array_position("posterior", top).cast("int") - 1]
    out = members.select("doc_id", "tokens", name.alias("domain"), top.alias("p_max"), fit.rate(F.col("posterior")).alias("rate")).withColumn("expected_tokens", F.col("rate") * F.col("tokens"))
    return out.withColumn("gap", F.lit(fit.gap)).withColumn("converged", F.lit(fit.converged))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], rules: MixRules | None = None, seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once
    more with a chance of the rest (decided by a hash of doc_id and text). Targets
    and rates only grow domains (min_rate 1), so no document is lost, whatever its
    columns hold; an empty table stays empty."""
    rules, keep = rules or MixRules(), Scratch(docs.sparkSession)
    model = fit_domains(docs, labels, rules, keep)
    # A row rides along whole in one column, so that names cannot clash and each text is judged once.
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    members = keep.saved(_with_posteriors(rows, model, rules, "tokens", "posterior").select("row", "tokens", "posterior"), "members", merge=False)
    fit = fit_rates(members, model.domains, weights, rules, keep, min_rate=1.0, grow_only=True)
    keep.drop(but=("members",))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(fit.rate(F.col("posterior"), 1.0) + chance).cast("int")
    return members.select("row", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).alias("times")).select("row.*")
