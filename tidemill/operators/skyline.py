"""Pareto fronts and who dominates whom, without a broadcast of the front.

Equal rows are one. Each task first drops what its own rows dominate; the rest is
range-partitioned into blocks of bounded size, of which the corners are known. Two
blocks meet only if the best corner of one reaches the worst corner of the other, and
send each other only the rows that lie between those corners: a task holds two blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expressions import quoted
from tidemill.functions.staging import staged

BLOCK = 4096


def complete(criteria: dict[str, str]) -> Column:
    """All criteria are there and finite."""
    return reduce(lambda a, b: a & b, (F.coalesce(quoted(c).isNotNull() & (F.abs(quoted(c).cast("double")) < F.lit(float("inf"))), F.lit(False)) for c in criteria))


def signed(criteria: dict[str, str]) -> list[Column]:
    """Criteria as ``s0, s1, ...``, larger being better."""
    return [((1 if way == "max" else -1) * quoted(c).cast("double") + F.lit(0.0)).alias(f"s{i}") for i, (c, way) in enumerate(criteria.items())]


def first_dominator(targets: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """For each target the index of the first filter that is as good everywhere and
    better somewhere, or -1."""
    out = np.full(len(targets), -1)
    open_ = np.arange(len(targets))
    for a in range(0, len(filters), 64):
        f = filters[a : a + 64]
        x = targets[open_]
        beats, better = np.ones((len(x), len(f)), bool), np.zeros((len(x), len(f)), bool)
        for d in range(targets.shape[1]):
            beats &= f[None, :, d] >= x[:, None, d]
            better |= f[None, :, d] > x[:, None, d]
        beats &= better
        hit = beats.any(axis=1)
        out[open_[hit]] = a + beats[hit].argmax(axis=1)
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy() for n in names]) if batch.num_rows else np.zeros((0, len(names)))


def _thinned(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Drops rows that a row of their own batch dominates: none of the front is lost."""

    def thin(batches):
        for batch in batches:
            x = _matrix(batch, names)
            x_order = np.argsort(-x.sum(axis=1), kind="stable")
            keep = first_dominator(x, x[x_order[:1024]]) < 0
            yield batch.filter(pa.array(keep))

    return vectors.mapInArrow(thin, vectors.schema)


def _blocked(rows: DataFrame, names: list[str], size: int) -> DataFrame:
    rows = staged(rows)
    parts = max(1, -(-rows.count() // size))
    order = [F.desc(n) for n in names]
    return staged(rows.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()))


def _met(targets: DataFrame, filters: DataFrame, names: list[str], by_key: bool) -> DataFrame:
    """``(s0, ..., key)`` of each target row that a filter row dominates, with the least
    key of a filter of each block that does (or of any, without ``by_key``)."""
    corner = lambda rows, side, f: rows.groupBy("block").agg(*(f(n).alias(f"{side}_{n}") for n in names)).withColumnRenamed("block", side)
    best, worst = corner(filters, "f", F.max), corner(targets, "t", F.min)
    # Corners: one row a block.
    pairs = staged(best.join(worst, reduce(lambda a, b: a & b, (F.col(f"f_{n}") >= F.col(f"t_{n}") for n in names))))
    inside = lambda side, compare: reduce(lambda a, b: a & b, (compare(F.col(n), F.col(f"{side}_{n}")) for n in names))
    f = filters.join(pairs, filters["block"] == pairs["f"]).filter(inside("t", lambda x, low: x >= low)).select("f", "t", *names, "key", F.lit(True).alias("filters"))
    t = targets.join(pairs, targets["block"] == pairs["t"]).filter(inside("f", lambda x, high: x <= high)).select("f", "t", *names, F.lit(None).cast(filters.schema["key"].dataType).alias("key"), F.lit(False).alias("filters"))

    def meet(group: pa.Table) -> pa.Table:
        own = group.filter(pa.compute.field("filters"))
        others = group.filter(~pa.compute.field("filters")).combine_chunks()
        x, y = _matrix(others, names), _matrix(own, names)
        order = pa.compute.sort_indices(own, sort_keys=[("key", "ascending")]).to_numpy() if by_key else np.argsort(-y.sum(axis=1), kind="stable")
        found = first_dominator(x, y[order])
        hit = np.flatnonzero(found >= 0)
        who = own.column("key").take(pa.array(order[found[hit]]))
        return pa.table([*(pa.array(x[hit, i]) for i in range(len(names))), who], names=[*names, "key"])

    kind = filters.schema["key"].dataType.simpleString()
    out = f.union(t).groupBy("f", "t").applyInArrow(meet, ", ".join([*(f"{n} double" for n in names), f"key {kind}"]))
    return out.groupBy(*names).agg(F.min("key").alias("key"))


def front_vectors(df: DataFrame, key: str, criteria: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``(s0, ..., key)``: the distinct signed vectors that no other dominates, each
    with the least key of its rows. Rows with a missing criterion take no part."""
    names = [f"s{i}" for i in range(len(criteria))]
    vectors = df.filter(complete(criteria)).select(*signed(criteria), quoted(key).alias("key")).groupBy(*names).agg(F.min("key").alias("key"))
    left = _blocked(_thinned(vectors, names), names, block)
    return left.join(_met(left, left, names, False).drop("key"), names, "left_anti").drop("block")


def pareto(df: DataFrame, key: str, criteria: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Rows that no other row dominates (as good everywhere, better somewhere). Equal
    rows do not dominate each other; rows with a missing criterion are left out."""
    names = [f"s{i}" for i in range(len(criteria))]
    front = front_vectors(df, key, criteria, block).drop("key")
    marks = [f"__{n}__" for n in names]
    marked = df.filter(complete(criteria)).select("*", *(c.alias(m) for c, m in zip(signed(criteria), marks)))
    return marked.join(front, [F.col(m) == F.col(n) for m, n in zip(marks, names)], "left_semi").drop(*marks)


def dominated(df: DataFrame, key: str, criteria: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``(key, dominated_by)`` of all rows with complete criteria: the least key of a
    row of the front that dominates it, null on the front itself."""
    names = [f"s{i}" for i in range(len(criteria))]
    rows = staged(df.filter(complete(criteria)).select(quoted(key).alias("__key__"), *signed(criteria)))
    front = front_vectors(df, key, criteria, block)
    targets = rows.select(*names).distinct().join(front, names, "left_anti")
    found = _met(_blocked(targets, names, block), _blocked(front, names, block), names, True).withColumnRenamed("key", "dominated_by")
    return rows.join(found, names, "left").select(F.col("__key__").alias(key), "dominated_by")
