"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for each centroid, the others by their distance from it. A vector
starts at the centroid it had and scans the others in that order; it stops at the
first strictly beyond twice its distance from the one it had, for nothing farther can
be nearer, nor as near. Assignments travel with the vectors from round to round; only
one sum a cluster and task is shuffled, and the centroids (``clusters`` rows) are all
that the driver holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, map_batches
from tidemill.llm.vectors import EXACT_IN_DOUBLE, matrix, whole_vectors


@dataclass(frozen=True)
class ClusterRules:
    """Clusters, rounds, components of a vector, and the seed before the ids whose
    hashes choose the first centroids."""

    clusters: int = 40
    rounds: int = 5
    size: int = 64
    seed: int = 2


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = rows - centroid
    return np.einsum("ij,ij->i", gap, gap)


def assign(rows: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cluster, squared distance, distances computed)`` of each row, from the
    cluster it had ``before``. All values are whole; ties go to the smaller number."""
    apart = np.stack([squared(centroids, c) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    best, score, computed = before.copy(), np.empty(len(rows), np.int64), len(rows)
    small = max(int(np.abs(rows).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT_IN_DOUBLE
    for a in np.unique(before):
        own = np.flatnonzero(before == a)
        x = rows[own]
        # Products of doubles are exact below 2^53 and much faster than of longs.
        mine = x.astype(np.float64) if small else x
        norms, start = np.einsum("ij,ij->i", mine, mine), squared(x, centroids[a])
        nearest, at = start.copy(), np.full(len(own), a)
        others = order[a][order[a] != a]
        # Strictly beyond twice the distance (four times the squared one): stop.
        limit = np.searchsorted(-(-apart[a][others] // 4), start, side="right")
        scan = np.argsort(-limit, kind="stable")
        for k in range(0, len(others), 8):
            scan = scan[: int(np.searchsorted(-limit[scan], -k, side="left"))]
            if not len(scan):
                break
            these = others[k : k + 8]
            c = centroids[these].astype(mine.dtype)
            found = norms[scan, None] - 2 * (mine[scan] @ c.T) + np.einsum("ij,ij->i", c, c)
            within = np.arange(k, k + len(these)) < limit[scan, None]
            computed += int(within.sum())
            for j, number in enumerate(these):
                d = found[:, j].astype(np.int64)
                closer = within[:, j] & ((d < nearest[scan]) | ((d == nearest[scan]) & (number < at[scan])))
                nearest[scan[closer]], at[scan[closer]] = d[closer], number
        best[own], score[own] = at, nearest
    return best, score, computed


def sort_means(vectors: DataFrame, rules: ClusterRules | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of each vector, and the final centroids.

    Vectors that are null, of another size, or hold null or non-finite components take
    no part (nor do those with components of 2^19 and beyond, whose distances fit no
    long). Rows that share an id are vectors of their own; a row without id is
    assigned but starts no cluster. With fewer vectors than clusters each starts one.
    Ties between first centroids' hashes go to the smaller vector. Other columns are
    not read; an empty table gives no rows."""
    rules = rules or ClusterRules()
    scratch = Scratch(vectors.sparkSession)
    kept = whole_vectors(vectors.filter(F.size(embedding) == rules.size), embedding, F.col(vec_id).alias("vec_id")).withColumn("cluster", F.lit(0))
    kept = scratch.saved(kept, "round0", merge=False)
    first = kept.filter("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(rules.clusters)
    centroids = np.array([r["v"] for r in first.select("v").collect()], np.int64).reshape(-1, rules.size)
    if not len(centroids):  # no vector has an id
        centroids = np.array([r["v"] for r in kept.orderBy("v").limit(rules.clusters).select("v").collect()], np.int64).reshape(-1, rules.size)
    kind = kept.schema["vec_id"].dataType.simpleString()
    for turn in range(rules.rounds + 1):
        final = turn == rules.rounds

        def assigned(batches, centroids=centroids):
            for batch in batches:
                rows = matrix(batch.column(1), rules.size)
                cluster, score, _ = assign(rows, batch.column(2).to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(score)], names=["vec_id", "v", "cluster", "distance"])

        kept = map_batches(kept.select("vec_id", "v", "cluster"), assigned, f"vec_id {kind}, v array<int>, cluster int, distance long")
        if final:
            return scratch.saved(kept.drop("v"), "assigned", merge=False), centroids
        kept = scratch.saved(kept, f"round{turn + 1}", merge=False)
        sums = kept.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(rules.size)]).alias("total"))
        centroids = centroids.copy()
        for row in sums.collect():  # one row a cluster
            centroids[row["cluster"]] = [t // row["n"] for t in row["total"]]
        scratch.drop(but=(f"round{turn + 1}",))
    raise AssertionError("unreachable")


def cluster_report(vectors: DataFrame, rules: ClusterRules | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``sort_means`` with, on each row, the summed distance of its cluster and of all
    clusters, and the digest of its cluster's final centroid."""
    found, centroids = sort_means(vectors, rules, vec_id, embedding)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # At most one row a cluster: small enough for every task.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    named = sums.join(found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
