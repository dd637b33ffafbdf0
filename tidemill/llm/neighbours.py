"""Nearest neighbours by shifted space-filling curves, then an exact check.

1. Vectors are turned by a seeded rotation, whose axes the curves take in turn, a few
   each, so that together they see every dimension; cells are shifted at random, and
   each vector gets the Hilbert key of its cell: one ordering a curve. Spark
   range-partitions rows by (curve, key).
2. Every row has a position in its ordering. Blocks of consecutive positions meet
   the queries whose window reaches into them; windows of all curves merge, and
   candidates are reranked by their true distance. Equal vectors are spread by
   position, so a vector that a third of the rows share is no hot spot.
3. The k-th distance found bounds an exact check of the stated queries against all
   rows: every task holds a bounded group of queries and passes over stretches of its
   rows whose ball lies beyond the bound of all of them; no row is shuffled. On data
   without structure in its many dimensions windows find what share of the rows they
   cover, and this check brings the recall to 1. ``exact=False`` leaves it out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, saved


@dataclass(frozen=True)
class CurveRules:
    """Curves, projected dimensions and bits of each (63 bits at most together),
    window half-width, rows in a block (at least the half-width), queries that a task
    checks at once, and the bounded sample (smallest hashes of vec_id) that sets the
    keys' scale."""

    curves: int = 12
    dims: int = 6
    bits: int = 10
    window: int = 256
    block: int = 2048
    queries: int = 4096
    sample: int = 4096
    seed: int = 17
    exact: bool = True


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (uint64) of integer cells (rows x dims, below 2**bits) along the
    Hilbert curve: axes are turned and mirrored from the coarsest bit down, then
    Gray-coded and interleaved."""
    axis = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(axis)):
            set_ = (axis[i] & high) != 0
            swap = np.where(set_, 0, (axis[0] ^ axis[i]) & low).astype(np.uint64)
            axis[0] = np.where(set_, axis[0] ^ low, axis[0] ^ swap)
            if i:
                axis[i] = axis[i] ^ swap
    for i in range(1, len(axis)):
        axis[i] = axis[i] ^ axis[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((axis[-1] >> np.uint64(b)) & one != 0, turn ^ np.uint64((1 << b) - 1), turn)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axis:
            key = (key << one) | (((a ^ turn) >> np.uint64(b)) & one)
    return key


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: id and vector not null, of the
    most frequent length (ties to the longer), all components finite, one not zero.
    Of rows with one id the least vector counts."""
    v = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kept = vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    size = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("v") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, allowed=None, bound: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of ``rows`` to each query by true distance, itself left out."""
    out = []
    for i, q in enumerate(query_ids):
        pick = np.flatnonzero((ids != q) if allowed is None else (ids != q) & allowed[i])
        if bound is not None and len(pick):
            rough = rows[pick] @ queries[i]
            rough = norms_of(rows[pick]) - 2 * rough + queries[i] @ queries[i]
            pick = pick[rough <= bound[i] ** 2 * (1 + 1e-9) + 1e-9 * (1 + queries[i] @ queries[i])] if np.isfinite(bound[i]) else pick
        if not len(pick):
            continue
        gap = rows[pick] - queries[i]
        score = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((ids[pick], score))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[pick][order], "score": score[order]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def norms_of(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


_FOUND = "query_id long, vec_id long, score double"


def _orderings(good: DataFrame, rules: CurveRules, every: int) -> DataFrame:
    """``(curve, position, vec_id, is_query, v)``, saved; positions count through
    all curves, ``v`` is the vector as bytes."""
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rules.sample).toArrow()
    points = np.array(sample["v"].to_pylist(), np.float64)
    n = points.shape[1] if points.ndim == 2 else 1
    dims = min(rules.dims, n)
    rng = np.random.default_rng(rules.seed)
    turned = np.concatenate([np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(-(-rules.curves * dims // n))], axis=1)
    frames, shifts = [turned[:, c * dims : (c + 1) * dims] for c in range(rules.curves)], rng.random((rules.curves, dims))
    centre = points.mean(axis=0) if len(points) else np.zeros(n)
    reach = max((float(np.abs((points - centre) @ f).max()) for f in frames), default=1.0) if len(points) else 1.0
    reach = reach or 1.0
    cells = 1 << rules.bits

    def keyed(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = batch.column(1).flatten().to_numpy().reshape(-1, n)
            raw = pa.array([r.tobytes() for r in rows], pa.binary())
            for c, (frame, shift) in enumerate(zip(frames, shifts)):
                at = ((rows - centre) @ frame / reach + 1) / 4 + shift / 2  # the cube's half, shifted
                key = hilbert_keys(np.clip(np.floor(at * cells), 0, cells - 1).astype(np.int64), rules.bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(key.astype(np.int64)), ids, raw], names=["curve", "key", "vec_id", "v"])

    keys = map_batches(good.select("vec_id", "v"), keyed, "curve int, key long, vec_id long, v binary")
    parts = max(1, int(good.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = keys.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id").withColumn("id", F.monotonically_increasing_id())
    placed = saved(placed, "curves")
    part = F.shiftright("id", 33)
    # One row for each partition of the sort.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    position = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("curve", position.alias("position"), "vec_id", (F.col("vec_id") % every == 0).alias("is_query"), "v")


def _windows(placed: DataFrame, rules: CurveRules, k: int) -> DataFrame:
    block, reach = rules.block, rules.window
    rows = placed.select(F.floor(F.col("position") / block).alias("block"), "curve", "position", "vec_id", "v", F.lit(False).alias("asks"))
    asked = placed.filter("is_query").select(F.explode(F.sequence(F.floor(F.greatest(F.col("position") - reach, F.lit(0)) / block), F.floor((F.col("position") + reach) / block))).alias("block"), "curve", "position", "vec_id", "v", F.lit(True).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if q.empty or r.empty:
            return _best(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((0, 0)), k)
        near = (np.abs(q["position"].to_numpy()[:, None] - r["position"].to_numpy()[None]) <= reach) & (q["curve"].to_numpy()[:, None] == r["curve"].to_numpy()[None])
        return _best(q["vec_id"].to_numpy(), _matrix(q["v"]), r["vec_id"].to_numpy(), _matrix(r["v"]), k, allowed=near)

    # A block holds ``block`` rows and the queries around it: a bounded group.
    return rows.union(asked).groupBy("block").applyInPandas(meet, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _checked(placed: DataFrame, near: DataFrame, rules: CurveRules, k: int) -> list[DataFrame]:
    """All rows within each query's bound, one frame a group of queries. Groups are
    ranges of the first ordering, so their bounds lie together."""
    rows = placed.filter("curve = 0").select("vec_id", "v")
    bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    asking = saved(placed.filter("curve = 0 and is_query").join(bound, "vec_id", "left").select("position", "vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "asking")
    out, low = [], -1
    while True:
        group = asking.filter(F.col("position") > low).orderBy("position").limit(rules.queries).toArrow()
        if not group.num_rows:
            return out
        low = group.column("position")[-1].as_py()
        ids, bounds = group.column("vec_id").to_numpy(), group.column("bound").to_numpy()
        queries = np.stack([np.frombuffer(v, np.float64) for v in group.column("v").to_pylist()])
        out.append(map_batches(rows, _scanner(ids, queries, bounds, k), _FOUND))


def _scanner(q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    def scan(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), [np.frombuffer(v, np.float64) for v in batch.column(1).to_pylist()]
            for a in range(0, len(ids), 512):
                some, rows = ids[a : a + 512], np.stack(vectors[a : a + 512])
                centre = rows.mean(axis=0)
                gap = np.sqrt(norms_of(queries - centre)) - np.sqrt(norms_of(rows - centre).max())
                reach = np.flatnonzero(gap <= bounds * (1 + 1e-9) + 1e-9)
                # A product tells roughly which rows may lie within a bound; those are measured.
                size = norms_of(queries[reach])[:, None] + 1
                rough = norms_of(rows)[None] - 2 * queries[reach] @ rows.T + size - 1
                i, j = np.nonzero((rough <= (bounds[reach, None] ** 2) * (1 + 1e-9) + 1e-9 * (size + norms_of(rows)[None])) & (some[None] != q_ids[reach, None]))
                gaps = rows[j] - queries[reach[i]]
                score = np.sqrt((gaps * gaps).sum(axis=1))
                order = np.lexsort((some[j], score, i))
                i, j, score = i[order], j[order], score[order]
                begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
                kept = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)])) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[reach[i[kept]]]), pa.array(some[j[kept]]), pa.array(score[kept])], names=["query_id", "vec_id", "score"])

    return scan


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, rules: CurveRules | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each query (ids
    divisible by ``every``), by Euclidean distance in double precision, nearest
    first, ties to the smaller vec_id; fewer if there are fewer rows.

    Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part, nor do rows without id; rows with one id count once;
    other columns are not read. An empty table gives no rows."""
    rules = rules or CurveRules()
    good = saved(usable(vectors, vec_id, embedding), "vectors")
    placed = saved(_orderings(good, rules, every), "placed")
    found = saved(_windows(placed, rules, k), "windows")
    best = _top(found, k)
    if rules.exact:
        for more in _checked(placed, saved(best, "near"), rules, k):
            found = found.union(more)
        best = _top(found, k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
