import base64
import hashlib
import io
import itertools
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, same
from tidemill.llm import html, langid, media, minhash, mixing, neighbours, packing, passages, secrets, warc, webp
from tidemill.llm.common import Scratch, scratch_path
from tidemill.llm.graph import components
from tidemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- media


def _scalar_decode(data):
    """A plain decoder of single-group pictures without transforms, bit by bit."""
    bits, at = [(b >> k) & 1 for b in data[20:] for k in range(8)], [0]

    def read(n):
        v = sum(bits[at[0] + k] << k for k in range(n))
        at[0] += n
        return v

    def code(alphabet):
        lengths = [0] * alphabet
        if read(1):
            two, wide = read(1), read(1)
            lengths[read(8 if wide else 1)] = 1
            if two:
                lengths[read(8)] = 1
        else:
            meta = [0] * 19
            for k in range(4 + read(4)):
                meta[webp.CODE_LENGTH_ORDER[k]] = read(3)
            tree, most, i, prev = walk(meta), alphabet, 0, 8
            assert not read(1)
            while i < most:
                s = symbol(tree)
                if s < 16:
                    lengths[i], prev, i = s, s or prev, i + 1
                else:
                    n = 3 + read(2) if s == 16 else 3 + read(3) if s == 17 else 11 + read(7)
                    lengths[i : i + n] = [prev if s == 16 else 0] * n
                    i += n
        return walk(lengths)

    def walk(lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) <= 1:
            return used[0][1] if used else 0
        out, value, size = {}, 0, used[0][0]
        for n, s in used:
            value <<= n - size
            out[n, value], value, size = s, value + 1, n
        return out

    def symbol(tree):
        if isinstance(tree, int):
            return tree
        value = n = 0
        while (n, value) not in tree:
            value, n = value << 1 | read(1), n + 1
        return tree[n, value]

    assert read(8) == 0x2F
    width, height = read(14) + 1, read(14) + 1
    read(4)
    assert not read(1) and not read(1) and not read(1)
    codes = [code(n) for n in (280, 256, 256, 256, 40)]
    out = []
    while len(out) < width * height:
        g = symbol(codes[0])
        if g < 256:
            r, b, a = symbol(codes[1]), symbol(codes[2]), symbol(codes[3])
            out.append(a << 24 | r << 16 | g << 8 | b)
        else:
            def number(s):
                return s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + read((s - 2) >> 1) + 1
            n, d = number(g - 256), number(symbol(codes[4]))
            if d > 120:
                d -= 120
            else:
                dx, dy = webp.NEAR_PIXELS[d - 1]
                d = max(dx + dy * width, 1)
            for _ in range(n):
                out.append(out[-d])
    return np.array(out, np.uint32).reshape(height, width)


def test_webp_round_trips_and_agrees_with_a_scalar_decoder():
    rng = np.random.default_rng(3)
    for trial in range(60):
        h, w = (int(x) for x in rng.integers(1, 30, 2))
        colours = rng.integers(0, 2**32, [1, 2, 4, 16, 200, 3000][trial % 6], dtype=np.uint64).astype(np.uint32)
        p = colours[rng.integers(0, len(colours), (h, w))]
        p = np.sort(p.ravel()).reshape(h, w) if trial % 3 == 0 else p
        assert (_scalar_decode(webp.encode(p)) == p).all()
        chosen = [t for t in (webp.PREDICTOR, webp.CROSS, webp.GREEN) if rng.random() < 0.5]
        rng.shuffle(chosen)
        chosen = ([webp.PALETTE] if len(np.unique(p)) <= 256 and trial % 2 else []) + chosen
        coded = webp.encode(p, tuple(chosen), int(rng.choice([0, 1, 5, 9])), 3, trial % 14)
        assert (webp.decode(coded) == p).all(), (trial, chosen)
        assert coded[:4] == b"RIFF" and struct.unpack("<I", coded[4:8])[0] == len(coded) - 8
    for bad in (b"", b"RIFF", coded[:30], coded[:12] + b"VP8 " + coded[16:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media_of_texts(spark, odd_docs):
    got = media.read_back(media.store_texts(odd_docs)).collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.select("doc_id", "text").collect())
    want = Counter()
    for (i, b), n in texts.items():
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += n
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    frame = media.store_texts(odd_docs).select("media").union(spark.createDataFrame([(None,), (b"nonsense",)], "media binary"))
    assert media.decode_pixels(frame.withColumn("width", F.lit(1))).filter("pixels is null").count() == 2


# ---------------------------------------------------------------- passages


def test_long_texts_are_stored_in_bounded_memory():
    data = np.tile(np.frombuffer(b"some words of a long text, over and over: 0123456789 ", np.uint8), 170_000)[: 8 << 20]
    tracemalloc.start()
    assert (media.from_pictures(media.to_pictures(media.pad(data))) == data).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)

    def brute(v, left, right, least, out):
        if right - left + 1 >= least:
            c = left + int(np.argmin(v[left : right + 1]))
            out.add((c, left, right))
            brute(v, left, c - 1, least, out)
            brute(v, c + 1, right, least, out)

    for _ in range(50):
        sizes = rng.integers(1, 60, rng.integers(1, 5))
        doc, least = np.repeat(np.arange(len(sizes)), sizes), int(rng.integers(1, 20))
        v, want, at = rng.integers(0, 2**63, len(doc)).astype(np.uint64), set(), 0
        for z in sizes.tolist():
            brute(v, at, at + z - 1, least, want)
            at += z
        assert set(zip(*(x.tolist() for x in passages.compact_windows(doc, v, least)))) == want


def test_repeated_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(20000)]
    docs = {i: rng.choices(words, k=rng.randint(30, 300)) for i in range(120)}
    held = set()
    for size, ids in ((60, range(0, 30)), (55, (40, 41)), (52, (50, 60, 70))):
        passage = rng.choices(words, k=size)
        for i in ids:
            at = rng.randint(0, len(docs[i]))
            docs[i][at:at] = passage
            held.add(i)
    line = rng.choices(words, k=20)
    for i in range(75, 120):
        docs[i][5:5] = line  # a common line is no passage
    docs[90] = rng.choices(words, k=200)
    docs[91] = [w if k % 60 else "edited" for k, w in enumerate(docs[90])]
    held |= {90, 91}
    rows = [(i, " ".join(t)) for i, t in docs.items()] + [(None, "x"), (500, None), (501, "")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == held
    for r in got:
        a, b = docs[r["doc_id"]][r["start"] : r["end"]], docs[r["other_id"]][r["other_start"] : r["other_end"]]
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _frequent_lines(seed, n=40):
    """Texts whose lines all occur in other contexts in the first ones, and pairs
    of later ones with a passage of such lines in common, one word changed."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(20000)]
    lines = [rng.choices(words, k=8) for _ in range(60)]
    fill = lambda k: rng.choices(words, k=k)
    docs = [sum((line + fill(30) for line in rng.sample(lines, 60)), []) for _ in range(6)]
    for _ in range(n):
        passage = sum(rng.sample(lines, 7), [])
        docs.append(fill(40) + passage + fill(40))
        near = list(passage)
        near[28] = "changed"
        docs.append(fill(60) + near + fill(20))
    return docs, [(6 + 2 * i, 7 + 2 * i) for i in range(n)]


def test_near_passages_of_frequent_lines_are_found(spark):
    docs, planted = _frequent_lines(5)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted({(r["other_id"], r["doc_id"]) for r in got}) == planted


def test_overlapping_passages_in_a_chain_are_found(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(20000)]
    rows, planted = [], []
    for i in range(60):
        x, p, z = (rng.choices(words, k=k) for k in (10, 45, 10))
        a, b, d = (rng.choices(words, k=30) + part + rng.choices(words, k=30) for part in (x + p, x + p + z, p + z))
        rows += [(3 * i + k, " ".join(text)) for k, text in enumerate((a, b, d))]
        planted += [(3 * i, 3 * i + 1), (3 * i + 1, 3 * i + 2)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted({(r["other_id"], r["doc_id"]) for r in got}) == planted


# ---------------------------------------------------------------- mixing


def test_rates_meet_reachable_targets(spark, odd_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["good", "fine", "nice"] if i % 3 else ["awful", "bad", "ugly"], k=20) + ["the"] * 5)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "up" if i % 3 else "down") for i in range(0, 600, 2)] + [(None, "up"), (3, None)], "doc_id long, domain string")
    got = mixing.mixing_rates(docs, labels, {"up": 0.25, "down": 0.75})
    sums = {r["domain"]: r["t"] for r in got.groupBy("domain").agg(F.sum("expected_tokens").alias("t")).collect()}
    assert sums["down"] / sum(sums.values()) == pytest.approx(0.75, abs=0.01)
    assert got.filter("rate < 0").count() == 0 and got.filter((F.col("domain") == "up") != (F.col("doc_id") % 3 != 0)).count() == 0
    assert {r["rate"] for r in mixing.mixing_rates(odd_docs, labels.limit(0), {}).collect()} == {1.0}
    assert mixing.mixing_rates(odd_docs.limit(0), labels, {"up": 1.0}).count() == 0
    mixed = mixing.mix(odd_docs, labels, {"up": 1.0})
    assert mixed.columns == odd_docs.columns and mixed.count() >= odd_docs.count()
    assert {r["converged"] for r in got.select("converged").distinct().collect()} == {True}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _least_squares(tokens, p, target, lowest=0.0, steps=20000):
    """Nonnegative least squares by coordinate descent over documents."""
    a = (tokens[:, None] * p).T
    r = np.full(len(tokens), max(1.0, lowest))
    s = a @ r
    for _ in range(steps // len(r)):
        for i in range(len(r)):
            if norm := a[:, i] @ a[:, i]:
                new = max(lowest, r[i] - a[:, i] @ (s - target) / norm)
                s += a[:, i] * (new - r[i])
                r[i] = new
    return np.abs(s - target).max() / tokens.sum(), float(((s - target) ** 2).sum() ** 0.5 / tokens.sum())


@pytest.mark.parametrize(
    ("case", "weights", "lowest"),
    [("narrow", (0.3, 0.7), 0.0), ("narrow", (0.05, 0.95), 1.0), ("absent", (0.5, 0.3, 0.2), 0.0)],
)
def test_rates_are_the_least_squares_optimum(spark, case, weights, lowest):
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 400, 200).astype(float)
    if case == "narrow":
        one = rng.uniform(0.5, 0.9, 200)
        p = np.stack([one, 1 - one], axis=1)
    else:
        p = rng.dirichlet([2.0, 3.0, 1.0], 200)
        if case == "absent":
            p = np.c_[p[:, 0] + p[:, 2], p[:, 1], np.zeros(200)]
    names = tuple("abc"[: p.shape[1]])
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens long, posterior array<double>").coalesce(1)
    target = np.array(weights) * tokens.sum()
    want, loss = _least_squares(tokens, p, target, lowest)
    fit = mixing.fit_rates(members, names, dict(zip(names, weights)), mixing.MixRules(steps=70), Scratch(spark), lowest)
    got = float(((np.array(fit.reached) - target) ** 2).sum() ** 0.5 / tokens.sum())
    assert got <= loss + 0.02 and fit.gap == pytest.approx(np.abs(np.array(fit.reached) - target).max() / tokens.sum())
    rates = [r[0] for r in members.select(fit.rate(F.col("posterior"), lowest)).collect()]
    assert min(rates) >= lowest and (tokens * rates) @ p == pytest.approx(np.array(fit.reached))
    assert fit.gap == pytest.approx(want, abs=0.03)


def test_domains_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_domains(docs, mixing.label_domains(labels), mixing.MixRules(), Scratch(spark))
    assert model.accuracy > max(math.exp(x) for x in model.prior) - 0.1


# ---------------------------------------------------------------- WARC


def test_archives_read_alike_at_any_split(spark):
    pages = spark.createDataFrame([(5, "http://a b\n", "x" * 100), (3, None, "x" * 100), (3, None, "x" * 100), (None, None, None), (9, "u", ""), (1, "u", "\x1f\x8b\x08" * 5000), (8, "é", "")], "page_id long, url string, html string")
    manifest = warc.write_pages(pages, scratch_path(spark, "t"))
    want = None
    for split in (1, 13, 1000, 1 << 20):
        rows = warc.read_records(manifest, split).collect()
        got = Counter((r["record_type"], r["fields"].get("x-page-id"), r["fields"].get("x-refers-to-page"), r["digest"]) for r in rows)
        want = want or got
        assert got == want and sum(got.values()) == 7
    told = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_report(spark, pages).collect()}
    assert told == {(5, "revisit", 3), (3, "response", None), (None, "response", None), (8, "response", None), (9, "revisit", 8), (1, "response", None)}
    assert warc.archive_report(spark, pages.limit(0)).count() == 0
    assert warc.digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()


# ---------------------------------------------------------------- neighbours


class _Counted(io.BytesIO):
    fetched = 0

    def read(self, *n):
        raw = super().read(*n)
        self.fetched += len(raw)
        return raw


def test_archives_are_read_forward_once():
    rng = random.Random(8)
    bodies = [rng.randbytes(rng.choice((0, 10, 300, 5000, 200_000))) for _ in range(3000)]
    data = b"".join(warc._record(i, f"http://x/{i}", body, None, "1970-01-01T00:00:00Z", 1) for i, body in enumerate(bodies))
    for split in (len(data), 8 << 20):
        found, fetched = [], 0
        for start in range(0, len(data), split):
            file = _Counted(data)
            found += [warc.parse(x[2])[1].partition(b"\r\n\r\n")[2] for x in warc.members(file, start, min(start + split, len(data)))]
            fetched += file.fetched
        assert found == bodies and fetched <= 1.2 * len(data)
    damaged = bytearray(data)
    at = [x[0] for x in warc.members(io.BytesIO(data), 0, len(data))]
    damaged[at[5] + 30 : at[5] + 60] = bytes(30)
    assert [x[0] for x in warc.members(io.BytesIO(bytes(damaged)), 0, len(data))] == at[:5] + at[6:]


def test_hilbert_curve_steps_by_one():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x[100:250] = x[7]  # a hot vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (None, [1.0] * 8), (800, [1.0])], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(frame, rules=neighbours.CurveRules(block=64, window=32)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    wide = x.astype(np.float64)
    assert sorted(got) == [0, 100, 200, 300, 400]
    for q in got:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert got[q] == [(int(i), round(d[i], 9)) for i in np.lexsort((np.arange(500), d))[:10]]
    assert neighbours.nearest(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- language


def test_language_model_on_held_out_documents(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.language_report(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out and n >= 100")
    assert told.filter("lang = lang_pred").count() >= 0.97 * told.count()
    model = langid.train(docs.filter("doc_id < 400"))
    rows = {r["doc_id"]: r for r in langid.identify(odd_docs.select("doc_id", "text"), model).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[6]["lang_pred"] == "und" and rows[6]["lang_score"] == 0 and rows[6]["lang_rejected"]
    assert rows[7]["lang_pred"] != "und" and all(0 <= r["lang_score"] <= 1 for r in rows.values())
    assert "_lang_pred" in langid.identify(odd_docs, model).columns
    assert langid.train(odd_docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs.select("doc_id", "text"), None).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns


# ---------------------------------------------------------------- near duplicates


def _components(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_near_duplicates_equal_brute_force(spark, odd_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs = {i: rng.choices(words, k=rng.randint(1, 120)) for i in range(150)}
    base, other = rng.choices(words, k=150), rng.choices(words, k=150)
    for i in range(150, 420):  # two families with 0 to 9 edits, around no member in the middle
        t = list(base if i % 3 else other)
        for _ in range(rng.randint(1, 9)):
            t[rng.randrange(150)] = rng.choice(words)
        docs[i] = t
    for i in range(420, 460):
        docs[i] = docs[420 - 7]
    texts = {i: " ".join(t) for i, t in docs.items()} | {1000: None, 1001: "", 1002: " \n", 1003: "A b", 1004: "a  B"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    small = minhash.SMALL_GROUP
    minhash.SMALL_GROUP = 4  # large groups get centres of their own
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    finally:
        minhash.SMALL_GROUP = small
    assert got == _components(texts)
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] for r in rows) and {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(odd_docs).count() == odd_docs.count()


def test_pairs_far_from_their_bucket_centre_are_linked(spark):
    fresh = iter(f"u{i}" for i in range(100000))
    new = lambda k: [next(fresh) for _ in range(k)]
    common, hub = new(40), new(10)
    docs = [common + hub + new(1) for _ in range(10)]
    for _ in range(20):
        own = new(60)
        docs += [common + own + new(2), common + own + new(2)]
    rules = minhash.NearDupRules(width=1, percent=85, bands=1, rows=1)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    band = {r["doc_id"]: r["bands"][0] for r in minhash.signatures(frame, rules).collect()}
    want = {b: b - 1 if band[b] == band[b - 1] else b for b in range(11, 50, 2)}
    assert sum(band[b] == band[0] for b in want) > 3  # buckets that the hub heads
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, rules).collect()}
    assert {b: got[b] for b in want} == want


def test_pipeline_drops_near_copies_at_080(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"v{i}" for i in range(20000)]
    docs = []
    for k in range(30):
        text = rng.choices(words, k=200)
        size = 13 + k % 10
        docs += [text, text[:60] + rng.choices(words, k=size) + text[60 + size :]]
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    near = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(30)]
    want = sorted([2 * k for k in range(30)] + [2 * k + 1 for k in range(30) if near[k] < 0.8])
    assert 30 < len(want) < 60
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == want


def test_super_minhash_estimates_similarity():
    u = np.random.default_rng(0).integers(0, 2**63, 1300).astype(np.uint64)
    sig = minhash.super_minhash(np.array([0, 1000, 2000, 2003, 2003]), np.r_[u[:1000], u[100:1100], u[:3]], 256)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.08
    assert np.isinf(sig[3]).all() and len(set(sig[2])) == 256


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# ---------------------------------------------------------------- secrets


def _base_spans(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_plain_patterns(spark, odd_docs):
    rng = random.Random(3)
    bits = ["password", "token", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é", "\n", "tok", "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_report(docs).collect():
        assert r["base_sha256"] == hashlib.sha256(_base_spans(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]]
    rows = secrets.secret_report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_hex"] == 0 for r in rows)
    masked = secrets.mask_secrets(spark.createDataFrame([(1, "my token = abcdef123 ok", 23), (2, None, None)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in masked] == [(1, "my [SECRET] ok", 14), (2, None, None)]


def test_sliding_entropy_equals_direct_entropy():
    rng = random.Random(5)
    for _ in range(200):
        s = "".join(rng.choices("abcdef0123456789XYZ"[: rng.randint(2, 19)], k=rng.randint(8, 60)))
        width, bits = 8, rng.choice([1.5, 2.0, 2.5])
        hot = set()
        for k in range(len(s) - width + 1):
            n = Counter(s[k : k + width])
            if -sum(c / width * math.log2(c / width) for c in n.values()) >= bits - 1e-9:
                hot |= set(range(k, k + width))
        assert {i for a, b in secrets.hot_windows(s, width, bits) for i in range(a, b)} == hot
    scanner = secrets.Scanner(secrets.EntropyRules())
    assert scanner.entropy("key Zx8Qw3Lr7Tb2Vn5Mk9Jp4 end") and not scanner.entropy("id 123e4567-e89b-12d3-a456-426614174000 end") and not scanner.entropy("averyveryverylongwordwithoutdigits")


# ---------------------------------------------------------------- packing


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(40, n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 5))

        def padding(ends):
            return sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts))

        best = min(padding((*some, int(lengths[-1]))) for z in range(min(k, n)) for some in itertools.combinations(map(int, lengths[:-1]), z))
        ends = packing.best_boundaries(lengths, counts, k)
        assert len(ends) <= k and padding(ends) == best


def test_batches_are_full_and_whole(spark, odd_docs):
    docs = spark.createDataFrame([(i % 50, "w " * (i * 7 % 90)) for i in range(400)], "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    rows = packing.pack(docs, packing.PackRules(buckets=4, budget=256, shard_rows=30)).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_tokens"] and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        slots[r["bucket"], r["batch"]].append((r["slot"], r["bucket_tokens"]))
    for (bucket, batch), got in slots.items():
        most = max(1, 256 // max(1, got[0][1]))
        last = max(b for k, b in slots if k == bucket)
        assert sorted(s for s, _ in got) == list(range(len(got))) and len(got) <= most and (batch == last or len(got) == most)
    lengths, counts = map(np.array, zip(*sorted(Counter(r["n_tokens"] for r in rows).items())))
    best = min(sum(n * (next(e for e in (*ends, lengths[-1]) if e >= x) - x) for x, n in zip(lengths, counts)) for ends in itertools.combinations(lengths[:-1].tolist(), min(3, len(lengths) - 1)))
    assert sum(r["padding"] for r in rows) == best
    assert packing.pack(docs.limit(0)).count() == 0


def test_many_lengths_are_taken_together():
    lengths, counts = packing._grouped(np.arange(1, 1002), np.ones(1001), 100)
    assert len(lengths) <= 100 and lengths[-1] == 1001 and counts.sum() == 1001 and (np.diff(lengths) <= 11).all()


def test_sums_of_embeddings_in_parts():
    rng = np.random.default_rng(0)
    table, bucket, at = rng.normal(size=(50, 3)), rng.integers(0, 50, 1000), np.array([0, 1, 400, 401, 990])
    before, langid._AT_ONCE = langid._AT_ONCE, 21
    try:
        assert np.allclose(langid._sums(table, bucket, at), np.add.reduceat(table[bucket], at, axis=0))
    finally:
        langid._AT_ONCE = before


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three<p>Four<div class='ad'>Buy</div></article><footer>(c)</footer>", "T & U\n\nOne two three\n\nFour"),
        ('<div class="sidebar">a</div><main><h1>T</h1><p>Hello <i>wor</i>ld &lt;b&gt; &nbsp; ok<p>two<form><input>go</form><div id="comments"><p>bad</p></div><aside>no</aside><p>end</main><footer>f', "T\n\nHello world <b> ok\n\ntwo\n\nend"),
        ("<article><header><h1>Title</h1></header><p>a<!-- c --><b>b</b><span class='ad'>zz</span>c</p><script>var x='</p>';</script></article>", "Title\n\nab\n\nc"),
        ("<p>The cat sat on the mat and it was the best of all of the days that she had with him in the house.</p><p>Short.</p><ul class='menu'><li>x</li></ul>", "The cat sat on the mat and it was the best of all of the days that she had with him in the house.\n\nShort."),
        ("<p>only a short one", "only a short one"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, html.BlockRules()) == text


def test_main_text_of_unknown_languages():
    first, second = ("Tämä pitkä kappale kertoo pohjoisen metsistä, järvistä sekä talvesta, " * 3).strip(), "文章" * 60
    links = "<p><a href=x>" + "luettelo linkkejä " * 6 + "</a></p>"
    assert html.main_text(f"<body><div>{first}</div>{links}<div>{second}</div></body>", html.BlockRules()) == f"{first}\n\n{second}"
    assert html.main_text(f"<article><p>{first}</p>{links}<p>{second}</p></article>", html.BlockRules()) == f"{first}\n\n{second}"


def test_blocks_of_links_do_not_empty_an_article():
    english = "the man and the dog were at the house and it was in the end for the best of all that they had " * 3
    code = "x1 = load(7); y2 = scan(x1, 99); print(x1 + y2, z3[4], q5[6]) # 1234567890 abcdef"
    links = "<p><a href=x>" + "list of links " * 6 + "</a></p>"
    page = f"<div>{english}</div><article>{links}<p>{code}</p></article>"
    assert code in html.main_text(page, html.BlockRules())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=it's>one</p><p>two</p><p>it's three</p></article>", "one\n\ntwo\n\nit's three"),
        ('<div class="article-with-sidebar"><p>kept text here</p><p class="side-effects">mild</p><p class="alert-free">calm</p><p class="social-history">old</p></div>', "kept text here\n\nmild\n\ncalm\n\nold"),
        ('<div class="widget"><article><p>the wrapper holds it all</p></article></div><div class="site-footer">f</div>', "the wrapper holds it all"),
        ('<article><p>short</p></article><div class="post-comments"><p>' + "a reader says so " * 20 + "</p></div>", "short"),
        ("<article><p>end is cut<b", "end is cut"),
        ("<article><p>end is cut</p><p class='x", "end is cut"),
        ("<article><p>a < b and 3<4 </ p> c</p><!--> d<!-- x --!> e</article>", "a < b and 3<4 c\n\nd e"),
        ("<article><p data-x='class=ad'>kept</p><script>if (a</b/) '</scriptx>'</script ><p>two</p></article>", "kept\n\ntwo"),
    ],
)
def test_markup_that_is_odd(page, text):
    assert html.main_text(page, html.BlockRules()) == text


def test_broken_tags_take_linear_time():
    for piece in ('<a "', "<a x='", "<a b ", "<b>", "</q>", "<div>", "<p ", "<!-", "<li><b>"):
        start = time.process_time()
        html.main_text(piece * 100_000, html.BlockRules())
        assert time.process_time() - start < 6, piece


class _Reader(HTMLParser):
    """Blocks by the standard library's parser: what paragraphs and headings hold."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.out = [], [], 0
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if (text := " ".join("".join(self.parts).split())) and not self.out:
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "i", "a"):
            self.cut()
            self.out += tag in ("nav", "footer", "form") or dict(attrs).get("class") in ("ad", "site-footer")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a"):
            self.cut()
            self.out = max(0, self.out - 1) if tag in ("nav", "footer", "form", "aside") else self.out

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.parts.append(data)


def test_blocks_agree_with_another_parser():
    rng = random.Random(3)
    words = ["it's", "a&amp;b", "x &lt; y", "caf&eacute;", "&#8364;", "plain", "1 < 2", "say \"so\"", "&nbsp;", "d&eacute;j&agrave;"]
    attrs = ["", " title=it's", " data-a='x>y'", ' data-b="<p>"', " hidden-not", " class=side-effects", " a=b/c", " = x", " class='article-with-sidebar'"]
    say = lambda: " ".join(rng.choices(words, k=rng.randint(1, 6)))
    for _ in range(300):
        body = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "div", "h2", "section", "nav", "footer", "script", "comment", "aside"])
            if kind == "script":
                body.append("<script>var a = '<p>no</p>';</script>")
            elif kind == "comment":
                body.append("<!-- <p>no</p> -->")
            elif kind == "aside":
                body.append("<form><b>no</b></form>")
            else:
                body.append(f"<{kind}{rng.choice(attrs)}>{say()}<{rng.choice('bi')}{rng.choice(attrs)}>{say()}</b><br>{say()}</{kind}>")
        page = f"<html><body><article>{''.join(body)}</article></body></html>"
        assert [b.text for b in html.blocks(page) if not b.dropped] == _Reader(page).found, page


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>é x</p></article>"), (2, "u", "")], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in html.page_texts(pages).collect()} == {(1, "", 0), (None, "é x", 3), (2, "", 0)}


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert same(df, connect(SF), ORACLE_SQL[name]) is None
    else:
        df.collect()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] <= counts[4]
    assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16,}")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == counts[4]
