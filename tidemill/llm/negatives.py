"""Hard negatives by distributed radix selection.

Anchors are taken in groups of bounded size, which every task holds; rows never move.
For each anchor (and later for each anchor and positive) there is a window of scores,
of which the k best rows are wanted:

1. Tasks score their rows and count, for each window, the highest digit of how far a
   score lies below the window's upper end. A task sends the buckets down to where its
   own count reaches k: the k-th of all rows lies in none farther.
2. The summed histogram shows the bucket of the k-th row; the next pass counts the
   next digit inside it. A window whose buckets so far hold few rows is settled early.
3. Then only rows down to the bucket found are gathered, k a task and window at most
   (nearest first, ties to smaller ids), and ranked.

Nothing that a group of rows shares grows in one place: equal rows are counts until
the last step, and then k of them a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, map_batches
from tidemill.llm.vectors import EXACT_IN_DOUBLE, matrix, whole_vectors

#: Bits of a digit.
DIGIT = 8
#: Scores that a task computes at once.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class NegativeRules:
    """Positives of an anchor, negatives of a positive, the hundredths of the
    positive's score between which a negative's lies, and anchors in a group."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    group: int = 2048


@dataclass
class _Windows:
    """Windows of one group of anchors: of each its anchor, best and worst score (a
    wanted row lies between), and the selection's state: the digits found so far,
    how many of its k rows lie before that bucket, and whether it is settled.

    ``same``: rows of the anchor's label are wanted, else rows of others."""

    anchor: np.ndarray
    best: np.ndarray
    worst: np.ndarray
    k: int
    same: bool

    def __post_init__(self):
        n = len(self.anchor)
        widest = int((self.best - self.worst).max(initial=0))
        self.digits = max(1, -(-max(widest, 1).bit_length() // DIGIT))
        self.prefix, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.settled = self.best < self.worst
        self.last = self.best - self.worst  # rows up to this far below the best are gathered

    def advance(self, digit: int, chosen: dict[int, tuple[int, int, int]]) -> None:
        """``chosen``: of a window the bucket of its k-th row, how many rows come
        before it, and how many it holds. Without one, all rows of it are wanted."""
        shift = DIGIT * (self.digits - 1 - digit)
        for w in np.flatnonzero(~self.settled).tolist():
            if w not in chosen:
                self.settled[w] = True
                continue
            bucket, before, held = chosen[w]
            self.prefix[w] = (self.prefix[w] << DIGIT) | bucket
            self.before[w] += before
            self.last[w] = min(self.last[w], ((self.prefix[w] + 1) << shift) - 1)
            if self.before[w] + held <= 4 * self.k:
                self.settled[w] = True


class _Scorer:
    """Scores of a batch's rows with a group's anchors, window by window."""

    def __init__(self, anchors: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, windows: _Windows):
        self.anchors, self.rows, self.labels, self.windows = anchors, rows, labels, windows
        self.first = np.searchsorted(windows.anchor, np.arange(len(rows) + 1))

    def hits(self, batch: pa.RecordBatch):
        """``(window, place in the batch, how far below the best)`` of all rows that
        belong to a window, in blocks."""
        row, label, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).value_lengths().to_numpy()
        w = self.windows
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            x = matrix(batch.column(3).take(pa.array(mine)), size)
            theirs = np.array([i for i, a in enumerate(self.anchors) if len(a) == size], np.int64)
            theirs = theirs[self.first[theirs + 1] > self.first[theirs]]
            for a in range(0, len(theirs), max(1, _BLOCK // max(len(mine), 1))):
                some = theirs[a : a + max(1, _BLOCK // max(len(mine), 1))]
                y = np.stack([self.anchors[i] for i in some])
                small = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0))) < EXACT_IN_DOUBLE
                score = (y.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if small else y @ x.T
                fits = (self.labels[some][:, None] == label[mine][None]) == w.same
                fits &= self.rows[some][:, None] != row[mine][None]
                count = self.first[some + 1] - self.first[some]
                reach = np.array([(w.best - w.last)[self.first[i] : self.first[i + 1]].min() for i in some])
                fits &= score >= reach[:, None]
                i, j = np.nonzero(fits)
                s = score[i, j]
                # Each hit meets the windows of its anchor: as many as it has positives.
                for nth in range(int(count.max(initial=0))):
                    has = count[i] > nth
                    window = self.first[some[i[has]]] + nth
                    far = w.best[window] - s[has]
                    inside = (far >= 0) & (far <= w.last[window])
                    yield window[inside], mine[j[has][inside]], far[inside]


def _histogram(scorer_of, windows: _Windows, digit: int):
    """Counts of one digit, a task's least buckets that together reach k."""
    shift = DIGIT * (windows.digits - 1 - digit)

    def count(batches):
        scorer = scorer_of()
        held = np.zeros((len(windows.anchor), 1 << DIGIT), np.int64)
        for batch in batches:
            codes = [np.zeros(0, np.int64)]
            for window, _, far in scorer.hits(batch):
                open_ = ~windows.settled[window] & ((far >> (shift + DIGIT)) == windows.prefix[window])
                codes.append((window[open_] << DIGIT) + ((far[open_] >> shift) & ((1 << DIGIT) - 1)))
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            held.ravel()[code] += n
        before, lacks = np.cumsum(held, axis=1) - held, windows.k - windows.before
        w, bucket = np.nonzero((held > 0) & (before < lacks[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(bucket, pa.int32()), pa.array(held[w, bucket]), pa.array(lacks[w])], names=["window", "bucket", "n", "lacks"])

    return count


def _gatherer(scorer_of, windows: _Windows):
    """Rows of each window down to the bucket found: the k best of a task."""

    def gather(batches):
        scorer = scorer_of()
        best = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            ids = batch.column(1).to_numpy()
            parts = [best, *((w, far, ids[at]) for w, at, far in scorer.hits(batch))]
            window, far, vec = (np.concatenate(x) for x in zip(*parts))
            by = np.lexsort((vec, far, window))
            window, far, vec = window[by], far[by], vec[by]
            begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]][: len(window)])
            keep = np.arange(len(window)) - np.repeat(begin, np.diff(np.r_[begin, len(window)])) < windows.k
            best = [window[keep], far[keep], vec[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(windows.best[best[0]] - best[1]), pa.array(best[2])], names=["window", "score", "vec_id"])

    return gather


def _select(rows: DataFrame, anchors: list[np.ndarray], row_ids: np.ndarray, labels: np.ndarray, windows: _Windows) -> DataFrame:
    """``(window, score, vec_id, rank)``: the k best rows of each window."""

    def scorer_of():
        return _Scorer(anchors, row_ids, labels, windows)

    for digit in range(windows.digits):
        if windows.settled.all():
            break
        # A window has at most 2^DIGIT buckets: they meet without a hot key.
        counts = map_batches(rows, _histogram(scorer_of, windows, digit), "window int, bucket int, n long, lacks long")
        sums = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n"), F.max("lacks").alias("lacks"))
        up_to = Window.partitionBy("window").orderBy("bucket")
        reached = sums.withColumn("upto", F.sum("n").over(up_to)).filter((F.col("upto") >= F.col("lacks")) & (F.col("upto") - F.col("n") < F.col("lacks")))
        chosen = {r["window"]: (r["bucket"], r["upto"] - r["n"], r["n"]) for r in reached.select("window", "bucket", "n", "upto").collect()}
        windows.advance(digit, chosen)
    found = map_batches(rows, _gatherer(scorer_of, windows), "window int, score long, vec_id long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= windows.k)


def hard_negatives(vectors: DataFrame, anchors: Column, rules: NegativeRules | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the whole inner product with the anchor, of components times 256
    rounded down; higher first, ties to the smaller id. The first rows of the anchor's
    label are its positives; for each, the first rows of other labels between
    ``low`` and ``high`` hundredths of its score are its negatives.

    Rows without id, label or vector, or with null or non-finite components (or of 2^19
    and beyond) take no part. Vectors of different lengths have no score with each
    other. Rows that share an id are rows of their own, and an anchor each; only the
    very row is no positive of itself. Other columns are not read. An empty table, or
    one without anchors, gives no rows."""
    rules = rules or NegativeRules()
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    usable = vectors.filter(F.col(vec_id).isNotNull() & label.isNotNull())
    kept = whole_vectors(usable, embedding, F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), anchors.alias("asks"))
    kept = scratch.saved(kept.withColumn("row", F.monotonically_increasing_id()), "vectors", merge=False)
    rows = kept.select("row", "vec_id", "label", "v")
    # Groups of anchors, by ranges of (vec_id, row): only the ranges' ends come here.
    asking = kept.filter(F.coalesce("asks", F.lit(False)))
    results, low = [], None
    while True:
        rest = asking if low is None else asking.filter((F.col("vec_id") > low[0]) | ((F.col("vec_id") == low[0]) & (F.col("row") > low[1])))
        group = rest.select("vec_id", "row", "label", "v").orderBy("vec_id", "row").limit(rules.group).toArrow()
        if not group.num_rows:
            break
        ids, own, labels = (group.column(x).to_numpy() for x in ("vec_id", "row", "label"))
        mine = [np.array(v, np.int64) for v in group.column("v").to_pylist()]
        low = (int(ids[-1]), int(own[-1]))
        bound = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x))).first()[0] if not results else bound
        # Cauchy-Schwarz: no score lies beyond the norms' product.
        most = np.array([int(np.ceil(np.sqrt(float(a @ a)) * np.sqrt(float(bound)))) + 1 for a in mine])
        positive = _Windows(np.arange(len(ids)), most, -most, rules.positives, True)
        liked = scratch.saved(_select(rows, mine, own, labels, positive), "positives")
        pairs = liked.orderBy("window", "rank").toArrow()  # a few rows for each anchor of the group
        of, score, who = (pairs.column(x).to_numpy() for x in ("window", "score", "vec_id"))
        best, worst = rules.high * score // 100, -(-rules.low * score // 100)
        negative = _Windows(of.astype(np.int64), best.astype(np.int64), worst.astype(np.int64), rules.negatives, False)
        found = _select(rows, mine, own, labels, negative)
        named = spark.createDataFrame([(int(i), int(ids[of[i]]), int(who[i]), int(score[i])) for i in range(len(of))], "window int, anchor_id long, positive_id long, positive_score long")
        found = found.withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id").join(F.broadcast(named), "window")
        results.append(scratch.saved(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        if group.num_rows < rules.group:
            break
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for x in results[1:]:
        out = out.union(x)
    return out
