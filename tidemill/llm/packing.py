"""Packing: optimal length buckets, and token-budget batches inside them.

The global histogram of lengths goes to the driver: as many rows as there are
distinct lengths, which the longest document bounds, not the corpus.
Dynamic programming over it finds the bucket boundaries with the least padding.
Batches need consecutive numbers inside a bucket; these come from numbers inside
small shards plus the shards' running totals, so a bucket that holds most of the
corpus is spread over as many tasks as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import saved


@dataclass(frozen=True)
class PackRules:
    """Buckets, tokens in a batch (padding included), rows in a shard, and, only if
    asked for, the number of lengths to which neighbouring ones are taken together
    (boundaries are then optimal among these)."""

    buckets: int = 12
    budget: int = 65536
    shard_rows: int = 20000
    grouped_lengths: int | None = None


def token_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (upper lengths, the last is the maximum) with the least total
    padding, ``buckets`` at most; of equal solutions that with fewer buckets.

    The cost of a bucket obeys the quadrangle inequality, so the best split point
    moves monotonically and divide and conquer needs n log n steps a layer."""
    n = len(lengths)
    if not n:
        return []
    rows = np.r_[0, np.cumsum(counts, dtype=np.float64)]
    mass = np.r_[0, np.cumsum(counts * lengths.astype(np.float64))]

    def cost(i, j):  # lengths[i:j] padded to lengths[j - 1]
        return (rows[j] - rows[i]) * lengths[j - 1] - (mass[j] - mass[i])

    layer = np.r_[0.0, [cost(0, j) for j in range(1, n + 1)]]
    back: list[np.ndarray] = [np.zeros(n + 1, np.int64)]
    best_k, best = 0, layer[n]
    for k in range(1, min(buckets, n)):
        following, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        stack = [(k + 1, n, k, n - 1)]
        while stack:
            a, b, lo, hi = stack.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(j - 1, hi) + 1)
            value = layer[i] + cost(i, j)
            at = int(value.argmin())
            following[j], cut[j] = value[at], i[at]
            stack += [(a, j - 1, lo, int(i[at])), (j + 1, b, int(i[at]), hi)]
        layer = following
        back.append(cut)
        if layer[n] < best:
            best_k, best = k, layer[n]
    ends, j = [], n
    for k in range(best_k, -1, -1):
        ends.append(int(lengths[j - 1]))
        j = int(back[k][j])
    return ends[::-1]


def _grouped(lengths: np.ndarray, counts: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` lengths: each the longest of equally many neighbours."""
    each = -(-len(lengths) // most) if most else 1
    if each <= 1:
        return lengths, counts
    first = np.arange(0, len(lengths), each)
    return lengths[np.minimum(first + each, len(lengths)) - 1], np.add.reduceat(counts, first)


def pack(docs: DataFrame, rules: PackRules | None = None) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding, over_budget)``
    for every row of ``docs(doc_id, text)``.

    ``bucket_tokens`` is the padded length of all rows of the bucket; a batch
    holds ``max(1, budget // bucket_tokens)`` rows, all batches of a bucket but
    its last one are full. A text longer than the budget is alone in its batch
    and marked over_budget. Null and blank texts have 0 tokens and are padded
    like others. Repeated rows are packed once each; rows that agree in doc_id and
    length may swap slots. An empty table gives no rows; other columns are not read."""
    rules = rules or PackRules()
    sized = saved(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")), "sized")
    histogram = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n")).toArrow().sort_by("length")
    ends = best_boundaries(*_grouped(histogram["length"].to_numpy(), histogram["n"].to_numpy(), rules.grouped_lengths), rules.buckets)
    total = int(histogram["n"].to_numpy().sum()) if len(ends) else 0
    bounds = F.array(*(F.lit(x).cast("long") for x in ends)) if ends else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(bounds, lambda x: x < F.col("n_tokens"))).cast("int")
    shards = max(1, -(-total // rules.shard_rows))
    placed = sized.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    running = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    width = F.greatest(bounds[F.col("bucket")], F.lit(1).cast("long"))
    rows = F.greatest(F.floor(F.lit(rules.budget) / width), F.lit(1)).cast("long")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1).join(before, ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("before"))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        bounds[F.col("bucket")].alias("bucket_tokens"),
        F.floor(F.col("place") / rows).cast("long").alias("batch"),
        (F.col("place") % rows).cast("long").alias("slot"),
        (bounds[F.col("bucket")] - F.col("n_tokens")).alias("padding"),
        (F.col("n_tokens") > rules.budget).alias("over_budget"),
    )
