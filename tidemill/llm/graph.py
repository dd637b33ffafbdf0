"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, map_batches

#: Edges that one task ties together at a time; bounds its memory.
TIED_EDGES = 200_000


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: label is the least
    node of its component. Nulls and self-loops link nothing. Works for any type
    with an order.

    First each task ties the edges it has, some at a time, to stars. Then each
    round points a node's neighbours at the least of them (first the larger
    neighbours, then the smaller ones), so hubs turn into stars and the number of
    rounds grows with the logarithm of the longest chain. A round is two
    aggregations with map-side minima, saved so that Spark can split the join back at
    a hub; the edges of each round are a table in the shared folder."""
    now = keep.saved(_tidy(_tied(edges.select("a", "b").filter("a != b"))), "edges")
    while not _stars(now):
        now = keep.saved(_small_star(keep.saved(_large_star(now, keep), "edges"), keep), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one least neighbour at most, and none if it is one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("least")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("least").alias("least")).filter("tied + least > 1").isEmpty()


def _tied(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: every node with the least one it is tied to."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            tied = [(x, r) for x in list(up) if (r := root(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t in tied], types[k]) for k in range(2)], names=["a", "b"])

        types = None
        for batch in batches:
            types = types or [batch.column(k).type for k in range(2)]
            for a, b in zip(*(batch.column(k).to_pylist() for k in range(2))):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            if len(up) >= TIED_EDGES:
                yield stars()
        if types:
            yield stars()

    return map_batches(edges, tie, edges.schema)


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller), once each."""
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Each neighbour larger than a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = keep.saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    return _tidy(both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    least = keep.saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
    ties = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(ties.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
