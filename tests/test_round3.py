"""Ties, repeats and row numbers that must not depend on how Spark deals the rows."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from tidemill import catalogue
from tidemill.functions.expressions import steady_sum
from tidemill.llm import minhash, passages
from tidemill.llm.common import Scratch
from tidemill.operators import robust
from tidemill.operators.rows import ordinals
from tidemill.operators.steps import Step
from tidemill.plans.pipeline import replay


def test_equal_alternatives_tie_whatever_the_order_of_their_rows(spark, tmp_path):
    prices = [0.1, 0.2, 0.3, 1e5, 7.7, 0.7]
    spark.createDataFrame([(k, 5.0) for k in (1, 2, 2)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(k, p, 1.0) for k, ps in ((1, prices), (2, prices[::-1])) for p in ps]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["s_suppkey"]: (r["price"], r["volume"]) for r in catalogue._alternatives(spark, str(tmp_path)).collect()}
    assert got[1][0] == got[2][0] == pytest.approx(sum(prices) / 6, rel=1e-12)
    assert got[1][1] == 6 and got[2][1] == 12  # a repeated supplier is one alternative, as in the SQL


def test_steady_sum_of_odd_values(spark):
    rows = [("a", -1.75), ("a", 0.5), ("b", None), ("c", 1e300), ("c", 2.0), ("d", float("inf")), ("e", float("nan")), ("e", 1.0)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(steady_sum(F.col("x"))).collect()))
    assert got["a"] == -1.25 and got["b"] is None and got["c"] == 1e300 and got["d"] == float("inf") and np.isnan(got["e"])


@pytest.mark.parametrize("ids,users,count", [([1, 1, 2, 3], [7, 7, 8, 8], 4), (list(range(300)), list(range(300)), None)])
def test_health_duplicates_are_those_of_the_asked_columns(spark, tmp_path, ids, users, count):
    rows = [(i, u, "view") for i, u in zip(ids, users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["code"], r["affected"]) for r in catalogue.QUERIES["health_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {("duplicate_rows", count)} | ({("high_cardinality", -1)} if count is None else set())


def test_repeated_events_are_one_row_of_the_answer(spark, tmp_path):
    spark.createDataFrame([(i // 2, i % 5, "view") for i in range(200)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["health_duplicates"](spark, str(tmp_path))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert compare.same(got, con, catalogue.ORACLE_SQL["health_duplicates"]) is None


def test_places_after_two_sorts_over_many_partitions(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100_000).select("id", ((F.col("id") * 7919) % 1009).alias("x"))
        steps = (Step("sort_rows", {"column": "id"}), Step("sort_rows", {"column": "x", "descending": True}))
        got = ordinals(replay(df, steps, keep_order=True), "place").select("id", "x", "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want = sorted(range(100_000), key=lambda i: (-(i * 7919 % 1009), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(100_000))


def test_noise_meets_rows_inside_tasks_with_the_same_draws(spark):
    """Rows are not multiplied by samples before the leaders are known, and equal rows share."""
    rows = [(i, float(i % 7 + 1), 10.0 + i % 5, None if i % 4 == 0 else 0.5) for i in range(40)] + [(None, 3.0, 10.0, 0.5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, sd double")
    samples = 30
    shares = robust.noise_shares(df, "id", {"a": "max", "b": "min"}, {"a": "sd"}, {"a": 1, "b": 1}, samples)
    draws = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    x = F.when(F.col("sd") > 0, F.col("a") + F.col("sd") * robust.normal_draw(44, F.col("s"), F.col("id"), "a")).otherwise(F.col("a"))
    want: dict = {}
    at = draws.select("s", "id", x.alias("a"), "b").toPandas()
    for _, g in at.groupby("s"):
        a, b = g["a"].to_numpy() / np.sqrt((g["a"] ** 2).sum()) / 2, g["b"].to_numpy() / np.sqrt((g["b"] ** 2).sum()) / 2
        p, m = np.hypot(a - a.max(), b - b.min()), np.hypot(a - a.min(), b - b.max())
        score = np.round(m / (p + m), 12)
        won = np.flatnonzero(score == score.max())
        for j in won:
            k = None if np.isnan(g["id"].iloc[j]) else int(g["id"].iloc[j])
            want[k] = want.get(k, 0) + 1 / len(won) / samples
    got = {r["id"]: r["share"] for r in shares.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "explode" not in shares._jdf.queryExecution().toString().lower()


def test_differences_that_no_far_member_needs_are_not_joined(spark, monkeypatch):
    """Members that are linked through the best one alone meet nobody by their differences."""
    seen = {}
    saved = minhash.Scratch.saved

    def counted(self, df, name, **more):
        out = saved(self, df, name, **more)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "saved", counted)
    rows = [(b"g", bytes([i]), bytes([i]), 100, d) for i, d in enumerate(([1, 2], [1, 2], [3], [3]))]
    members = spark.createDataFrame(rows, "g binary, node binary, label binary, size long, delta array<long>")
    links, further = minhash._apart(members, minhash.NearDupRules(width=5, percent=80), minhash.Scratch(spark))
    assert links.count() == 3 and further is None
    assert sum(seen.get(name, 0) for name in ("told", "far", "near")) == 0


def test_differences_of_one_label_alone_are_not_told(spark, monkeypatch):
    """Far members that are linked already share most differences only with each other."""
    seen = {}
    saved = minhash.Scratch.saved

    def counted(self, df, name, **more):
        out = saved(self, df, name, **more)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "saved", counted)
    far = [(b"g", bytes([i]), b"f", 100, [99, *range(1000, 1060)]) for i in (1, 2)]
    core = [(b"g", bytes([i]), b"c", 100, [99, i]) for i in range(10, 30)]
    members = spark.createDataFrame(far + core, "g binary, node binary, label binary, size long, delta array<long>")
    links, further = minhash._apart(members, minhash.NearDupRules(width=5, percent=80), minhash.Scratch(spark))
    assert links.count() == 0 and further is None
    assert sum(seen.get(name, 0) for name in ("told", "far", "near")) == 0


@pytest.mark.parametrize("small", [4, 1024])
def test_links_of_a_group_over_rounds_are_those_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_GROUP", small)
    draw = np.random.default_rng(5)
    base, rules = set(range(40)), minhash.NearDupRules(width=5, percent=80)
    families = [set(draw.choice(40, k, replace=False)) | set(draw.choice(np.arange(100, 130), k, replace=False)) for k in (0, 4, 5, 6, 7, 8)]
    sets = {bytes([i]): base ^ families[i % 6] ^ set(draw.choice(np.r_[0:40, 100:160], int(draw.integers(0, 6)), replace=False)) for i in range(72)}
    rows = [(b"g", k, k, len(x), [int(e) for e in x ^ base]) for k, x in sets.items()]
    members = spark.createDataFrame(rows, "g binary, node binary, label binary, size long, delta array<long>")
    keep, found, rounds = minhash.Scratch(spark), [], 0
    while members is not None and (got := minhash._apart(members, rules, keep)):
        found += [(bytes(r["a"]), bytes(r["b"])) for r in got[0].collect()]
        members, rounds = got[1], rounds + 1

    def parts(edges):
        of = {k: k for k in sets}
        for a, b in edges:
            of = {k: min(of[a], of[b]) if v in (of[a], of[b]) else v for k, v in of.items()}
        return of

    pairs = [(a, b) for a in sets for b in sets if a < b]
    want = parts([(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert parts(found) == want and len(set(want.values())) > 3
    assert rounds > 1 or small > 4


def test_passages_that_meet_again_find_the_tables_before_deleted(spark, monkeypatch):
    """What the second meeting no longer needs must not take up disk beside it."""
    held = {}
    saved = passages.Scratch.saved

    def watched(self, df, name, **more):
        held.setdefault(name, []).append({label for label, _ in self.paths})
        return saved(self, df, name, **more)

    monkeypatch.setattr(passages.Scratch, "saved", watched)
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {line} c{i}") for i in range(5)], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert sorted((r["doc_id"], r["other_id"], r["start"], r["end"]) for r in got) == [(i, 0, 2, 62) for i in range(1, 5)]
    assert held["again"] == [{"sequences", "told", "members"}]
    assert held["met"][1] == {"sequences", "told", "again", "groups"}


def test_shuffle_files_of_the_last_step_are_gone_before_the_next(spark):
    """The files of the job just ended outlived a collection, so a step's shuffle lay beside the next one's."""
    keep = Scratch(spark)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}
    keep.forget()
    time.sleep(1)
    before = files()
    keep.saved(spark.range(100_000).groupBy(F.xxhash64("id").alias("id")).count(), "counts")
    step = files() - before
    assert step
    keep.forget()
    for _ in range(50):
        if not files() & step:
            break
        time.sleep(0.1)
    assert not files() & step
    keep.drop()


def test_a_pair_full_of_repeated_lines_is_verified_by_few_comparisons(monkeypatch):
    """Every occurrence of an anchor in the other text was compared on its own, shingle by shingle."""
    rng = np.random.default_rng(3)
    line = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    fill = lambda k: rng.integers(0, 1 << 32, k, dtype=np.uint32)
    a = np.concatenate([np.concatenate([line, fill(60)]) for _ in range(40)])
    b = np.concatenate([np.concatenate([line, fill(60)]) for _ in range(200)])
    run = fill(50)
    a, b = np.concatenate([a, run[:25], line[:1], run[25:]]), np.concatenate([b, run[:25], line[:1], run[25:]])
    runs, plain = [], passages._run
    monkeypatch.setattr(passages, "_run", lambda *given: runs.append(given) or plain(*given))
    pair = passages._Pair(a, b, passages.PassageRules())
    assert all(pair.passage(k) is None for k in range(0, 4000, 100))  # 40 of 46 shingles are no passage
    assert pair.passage(4025)[:4] == (4000, 4051, 20000, 20051)
    assert len(runs) <= 1
