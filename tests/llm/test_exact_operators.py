"""Hard negatives, repeats by run-length indexes and sort-means, each against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm.centroids import ClusterRules, assign, cluster_report, squared
from tidemill.llm.negatives import NegativeRules, hard_negatives
from tidemill.llm.repeats import RepeatRules, repeat_report
from tidemill.llm.runindex import Strings, repeats_of_earlier

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, row int, v string, cluster string")


def whole(v):
    return [int(np.floor(256 * float(x))) for x in v]


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def odd_vectors(size, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [float(np.float32(x)) for x in rng.integers(-3, 4, size) / 4]
        if i % 3 == 0:  # a third of the rows share a vector
            v = [0.5] * size
        rows.append((i if i % 11 else i - 1, int(rng.integers(0, 3)), v, 0, "x", "y"))
    rows += [(None, 1, [0.5] * size, 0, "", ""), (500, None, [0.5] * size, 0, "", ""), (501, 1, None, 0, "", ""), (502, 1, [0.5] * (size - 1) + [None], 0, "", ""),
             (503, 1, [NAN] * size, 0, "", ""), (504, 1, [INF] + [0.5] * (size - 1), 0, "", ""), (505, 1, [], 0, "", ""), (510, 1, [0.25] * 3, 0, "", ""), (511, 1, [0.5] * 3, 0, "", ""), (520, 2, [0.375] * 3, 0, "", "")]
    return rows


def plain_negatives(rows, every, rules):
    kept = [(n, i, lab, whole(v)) for n, (i, lab, v, *_) in enumerate(rows) if i is not None and lab is not None and sound(v)]
    out = []
    for n, a, lab, v in kept:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m, label) for m, i, label, w in kept if m != n and len(w) == len(v)]
        for p, pid, _, _ in sorted(x for x in scored if x[3] == lab)[: rules.positives]:
            fits = sorted(x for x in scored if x[3] != lab and rules.low * -p <= 100 * -x[0] <= rules.high * -p)
            out += [(a, pid, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits[: rules.negatives])]
    return sorted(out)


@pytest.mark.parametrize("group", [7, 2048])
def test_negatives_equal_brute_force(spark, group):
    rows, rules = odd_vectors(8, 120, 1), NegativeRules(group=group)
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0, rules)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 5, rules)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_of_wide_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in (rng.normal(size=6) + 1) * 3000], 0, "", "") for i in range(200)]
    rules = NegativeRules()
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") % 20 == 0, rules)
    rows = [(i, lab, [np.float32(x) for x in v], *r) for i, lab, v, *r in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 20, rules)


def test_negatives_of_empty_tables(spark):
    assert hard_negatives(vectors(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives(vectors(spark, [(1, 1, [0.5], 0, "", "")]), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives(vectors(spark, [(5, 1, [0.5], 0, "", "")]), F.col("vec_id") % 5 == 0).count() == 0


def plain_clusters(rows, rules):
    kept = [(i, whole(v)) for i, _, v, *_ in rows if sound(v) and len(v) == rules.size]
    start = sorted((hashlib.sha256(f"{rules.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[: rules.clusters]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rules.rounds):
        mine = [nearest(v)[1] for _, v in kept]
        groups = [[v for m, (_, v) in zip(mine, kept) if m == k] for k in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = lambda k: sum(d for _, d, c in found if k in (None, c))
    return sorted(((i, c, d, total(c), total(None), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=str)


@pytest.mark.parametrize("clusters", [4, 9, 500])
def test_clusters_equal_brute_force(spark, clusters):
    rows, rules = odd_vectors(8, 150, 2), ClusterRules(clusters=clusters, rounds=4, size=8)
    got = cluster_report(vectors(spark, rows), rules)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, rules)


def test_clusters_of_an_empty_table(spark):
    assert cluster_report(vectors(spark, [])).count() == 0
    assert cluster_report(vectors(spark, odd_vectors(8, 5, 1))).count() == 0  # none has 64 components


@pytest.mark.parametrize("scale", [50, 1 << 26])
def test_scan_stops_early_and_keeps_ties(scale):
    rng = np.random.default_rng(3)
    centroids = rng.integers(-scale, scale, (30, 16))
    centroids[7] = centroids[3]
    rows = np.concatenate([centroids[rng.integers(0, 30, 400)] + rng.integers(-scale // 20, scale // 20 + 1, (400, 16)), rng.integers(-scale, scale, (50, 16))])
    cluster, score, computed = assign(rows, rng.integers(0, 30, len(rows)), centroids)
    table = np.stack([squared(rows, c) for c in centroids], axis=1)
    assert (cluster == table.argmin(axis=1)).all() and (score == table.min(axis=1)).all()
    again, _, few = assign(rows, cluster, centroids)
    assert (again == cluster).all() and few < 0.4 * table.size <= computed


def plain_repeats(rows, least):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for s in range(len(b) - least + 1 if i is not None else 0):
            w = b[s : s + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1 if i is not None else 0):
            if first[b[s : s + least]] < i:
                gone[s : s + least] = b"\1" * least
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8), 0].astype(int))).reshape(-1, 2)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(edges), hashlib.sha256(left).hexdigest(), ",".join(f"{x}:{y}" for x, y in edges), left))
    return sorted(out, key=str)


def odd_texts(n, seed):
    r = random.Random(seed)
    words = ["alpha", "béta", "gamma", "日本", "eps", "zeta", "eta", "theta", "\x00", "kappa\n"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    line, rows = text(14), []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            t = r.choice(rows)[1] or ""
            a = r.randrange(len(t) + 1)
            t = t if kind < 0.15 else t[:a] + r.choice("Qé") + t[a:]
        else:
            t = None if kind < 0.55 else "" if kind < 0.6 else "a" * r.randrange(40, 300) if kind < 0.65 else text(r.randrange(0, 60))
        rows.append((i, (t or "")[:50] + line + (t or "")[50:] if r.random() < 0.35 else t))
    return rows


@pytest.mark.parametrize("rules", [RepeatRules(), RepeatRules(split=2, common=2), RepeatRules(gather_bytes=1000, common=1 << 30), RepeatRules(least=8, gram=5)])
@pytest.mark.parametrize("ids", ["own", "shared"])
def test_repeats_equal_brute_force(spark, rules, ids):
    rows = odd_texts(120, 5)
    if ids == "shared":
        rows = [(None if i % 17 == 0 else 3 if i % 5 == 0 else i, t) for i, t in rows] + [(3, rows[4][1]), (3, rows[4][1])]
    docs = spark.createDataFrame([(*x, 1, "m", [2]) for x in rows], "doc_id long, text string, doc int, mark string, starts array<int>")
    want = plain_repeats(rows, rules.least)
    assert sum(x[2] for x in want) > 1000
    assert sorted([tuple(bytes(v) if isinstance(v, bytearray) else v for v in x) for x in repeat_report(docs, rules).collect()], key=str) == want


def test_repeats_inside_long_texts(spark):
    r = random.Random(1)
    big = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(10**6)) for _ in range(250_000))
    assert len(big) > 1 << 21
    rows = [(1, big), (2, "x" + big[1_048_500:1_048_700] + "y"), (0, big[(1 << 21) - 90 : (1 << 21) + 70]), (3, big[7:])]
    got = {x["doc_id"]: (x["n_removed"], x["spans"]) for x in repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, ""), 1: (160, f"{(1 << 21) - 90}:{(1 << 21) + 70}"), 2: (200, "1:201"), 3: (len(big) - 7, f"0:{len(big) - 7}")}


def test_repeats_of_an_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_run_length_index_finds_what_search_finds():
    rng = np.random.default_rng(1)
    for _ in range(30):
        alphabet, least = int(rng.integers(1, 5)), int(rng.integers(8, 16))
        base = [rng.integers(0, alphabet, 80).astype(np.uint8) for _ in range(4)]
        texts = []
        for _ in range(int(rng.integers(2, 50))):
            t = base[rng.integers(4)][: rng.integers(1, 80)].copy()
            t[rng.integers(0, len(t), rng.integers(0, 3))] = 255
            texts.append(t[rng.integers(0, 4) :].tobytes())
        texts = [t for t in dict.fromkeys(texts) if t]
        group, rank = rng.integers(0, 3, len(texts)), rng.integers(0, 9, len(texts))
        strings = Strings(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
        got = set(zip(*(x.tolist() for x in repeats_of_earlier(strings, group, rank, least))))
        want = {(i, s) for i, t in enumerate(texts) for s in range(len(t) - least + 1)
                if any(t[s : s + least] in u for j, u in enumerate(texts) if group[j] == group[i] and rank[j] < rank[i])}
        assert got == want


def test_recall_of_the_curves_alone(spark):
    """Without the exact check, on the given vectors (2000 of 64 dimensions)."""
    from tidemill.llm.common import table
    from tidemill.llm.neighbours import CurveRules, nearest

    given = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = given.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {(r["query_id"], r["vec_id"]) for r in nearest(given, rules=CurveRules(exact=False)).collect()}
    true = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if k != i][:10]
        true |= {(int(ids[i]), int(ids[k])) for k in order}
    assert len(true & found) >= 0.9 * len(true), len(true & found) / len(true)
    assert {(r["query_id"], r["vec_id"]) for r in nearest(given).collect()} == true
