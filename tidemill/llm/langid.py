"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its byte n-grams (2 to 4 bytes) inside a word or reaching
one byte over its edge, hashed to buckets. The model averages the buckets'
embeddings and applies a linear softmax; stochastic gradient descent in numpy
trains both on a bounded sample of labelled rows. Because averaging and the
linear layer commute, prediction uses one table of buckets x languages: a sum of
table rows for each text, in one pass, with no shuffle.

A fifth of the sample calibrates: a temperature that minimises the loss, and the
probability under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import byte_column, chunks, free_name, map_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class LangRules:
    """``sample_docs`` bounds the labelled rows that training reads (shared out
    equally among the languages, two each at least), however large the corpus is. ``snippets`` short
    cuts of each sampled text are further training rows, so that short texts are
    learned too."""

    sample_docs: int = 1000
    snippets: int = 3
    bucket_bits: int = 16
    dims: int = 16
    epochs: int = 5
    rate: float = 20.0
    seed: int = 7
    reject_share: float = 0.001
    reject_most: float = 0.3


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets + 1 (a zero row for what is no feature) x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each n-gram size an array of buckets, one for each byte of ``data``;
    ``1 << bits`` where no n-gram starts. N-grams stay inside a text."""
    low = _KEEP[data]
    gap = low == 0x20
    n, none, out = len(low), np.uint32(1 << bits), []
    code = low.astype(np.uint32)
    for size in (2, 3, 4):
        bucket = np.full(n, none, np.uint32)
        if n >= size:
            m = n - size + 1
            code = code[:m] | (low[size - 1 :].astype(np.uint32) << np.uint32(8 * (size - 1)))
            value = ((code ^ np.uint32(size * 0x9E3779B1 % (1 << 32))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
            bad = gap[:m] & gap[1 : m + 1] if size == 2 else gap[1 : m + 1].copy()
            if size == 4:
                bad |= gap[2 : m + 2]
            bucket[:m] = np.where(bad, none, value)
            for back in range(1, size):
                cut = offsets[1:] - back
                bucket[cut[cut >= 0]] = none
        out.append(bucket)
    return out


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    out = np.zeros(len(offsets) - 1, bool)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        plain = (_KEEP[data] != 0x20) & (data < 0x80)
        out[full] = np.add.reduceat(plain, offsets[:-1][full], dtype=np.int64) > 0
    for i in full[~out[full]]:
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: Numbers that a sum of embeddings holds at once.
_AT_ONCE = 1 << 23


def _sums(table: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``table[bucket]`` between the starts ``at``, a bounded part at a time."""
    out = np.zeros((len(at), table.shape[1]))
    step = max(1, _AT_ONCE // table.shape[1])
    for p in range(0, len(bucket), step):
        part = bucket[p : p + step]
        first, last = int(np.searchsorted(at, p, "right")) - 1, int(np.searchsorted(at, p + len(part), "left"))
        out[first:last] += np.add.reduceat(table[part], np.maximum(at[first:last], p) - p, axis=0)
    return out


def logits(model: LangModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x languages, before the temperature."""
    n, bits = len(offsets) - 1, int(np.log2(len(model.table) - 1))
    total, count = np.zeros((n, len(model.languages))), np.zeros(n)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for bucket in features(data, offsets, bits):
            total[full] += _sums(model.table, bucket, at)
            count[full] += np.add.reduceat(bucket != len(model.table) - 1, at, dtype=np.int64)
    return total / np.maximum(count, 1)[:, None] + model.bias


def _sample(labelled: DataFrame, rules: LangRules) -> tuple[list[str], int, DataFrame | None]:
    """Languages, rows for each, and the sample's features ``(lang, draw, doc,
    part, buckets, weights)``, made where the texts are."""
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return [], 0, None
    each = max(2, -(-rules.sample_docs // len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.1 * each / r["count"]) * (1 << 30))))])
    picked = labelled.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.LongType()), T.StructField("doc", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("buckets", T.BinaryType()), T.StructField("weights", T.BinaryType())])
    bits, snippets, seed = rules.bucket_bits, rules.snippets, rules.seed

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = byte_column(batch.column(3))
            rows: list[list] = [[] for _ in range(6)]
            for i, (lang, draw, doc) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                body = data[offsets[i] : offsets[i + 1]]
                rng = np.random.default_rng([seed, draw])
                cuts = [(0, len(body))]
                for _ in range(snippets if len(body) > 40 else 0):
                    size = int(min(len(body), 20 * 2 ** rng.uniform(0, 4)))
                    at = int(rng.integers(0, len(body) - size + 1))
                    cuts.append((at, at + size))
                for part, (a, b) in enumerate(cuts):
                    found = np.concatenate(features(body[a:b], np.array([0, b - a]), bits))
                    bucket, n = np.unique(found[found < (1 << bits)], return_counts=True)
                    if len(bucket):
                        for column, value in zip(rows, (lang, draw, doc, part, bucket.astype(np.int32).tobytes(), (n / n.sum()).astype(np.float32).tobytes())):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=schema.names)

    return sorted(r["lang"] for r in counts), each, map_batches(picked.select("lang", "draw", F.col("doc_id").cast("string").alias("doc"), "text"), extract, schema)


def _fit(rows: list[tuple], languages: list[str], each: int, rules: LangRules) -> LangModel | None:
    """Stochastic gradient descent over the sample, in an order of its own."""
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3], r[4]))
    sample, docs = [], {}
    for lang, draw, doc, part, buckets, weights in rows:
        mine = docs.setdefault(lang, {})
        order = mine.setdefault((draw, doc), len(mine))
        if order < each:
            sample.append((lang, order, part, np.frombuffer(buckets, np.int32), np.frombuffer(weights, np.float32)))
    if not sample:
        return None
    code = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(rules.seed)
    size, L = 1 << rules.bucket_bits, len(languages)
    embed = rng.normal(0, rules.dims**-0.5, (size, rules.dims)).astype(np.float32)
    linear, bias = np.zeros((rules.dims, L), np.float32), np.zeros(L, np.float32)
    fit = [r for r in sample if r[1] % 5 or r[1] == 0]
    hold = [r for r in sample if r[1] % 5 == 0 and r[1]] or fit
    steps, step = rules.epochs * len(fit), 0
    for _ in range(rules.epochs):
        for k in rng.permutation(len(fit)):
            lang, _, _, bucket, weight = fit[k]
            rate = rules.rate * (1 - step / steps)
            step += 1
            mine = embed[bucket]
            mean = weight @ mine
            error = _softmax(mean @ linear + bias)
            error[code[lang]] -= 1
            back = linear @ error
            linear -= np.float32(0.05 * rate) * np.outer(mean, error)
            bias -= np.float32(0.0005 * rate) * error
            embed[bucket] = mine - np.float32(rate) * weight[:, None] * back
    table = np.zeros((size + 1, L), np.float32)
    table[:size] = embed @ linear
    z = np.array([r[4] @ table[r[3]] + bias for r in hold])
    true = np.array([code[r[0]] for r in hold])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 61))
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(true)), true], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    whole = np.array([r[2] == 0 for r in hold])
    best = _softmax(z / temperature)[whole].max(axis=1) if whole.any() else np.ones(1)
    return LangModel(tuple(languages), table, bias, temperature, float(min(rules.reject_most, np.quantile(best, rules.reject_share, method="lower"))))


def train(labelled: DataFrame, rules: LangRules | None = None) -> LangModel | None:
    """A model from ``labelled(doc_id, lang, text)``; rows with a null are left
    out, None if none remains. The same rows give the same model.

    The sample is bounded, so one task trains on it; the driver gets the table."""
    rules = rules or LangRules()
    languages, each, sample = _sample(labelled.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null"), rules)
    if sample is None:
        return None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        model = _fit(rows, languages, each, rules)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()]), pa.array([model.bias.tobytes()]), pa.array([model.temperature]), pa.array([model.reject_below])], names=["t", "b", "temperature", "reject"])

    row = map_batches(sample.repartition(1), fit, "t binary, b binary, temperature double, reject double").first()
    if row is None:
        return None
    table = np.frombuffer(bytes(row["t"]), np.float32).reshape(-1, len(languages))
    return LangModel(tuple(languages), table, np.frombuffer(bytes(row["b"]), np.float32), row["temperature"], row["reject"])


def identify(docs: DataFrame, model: LangModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected`` (named with
    underscores in front where they clash).

    A text that is null or has no letter gets ``und``, score 0 and is rejected;
    without a model (nothing was labelled) all texts get ``und``, score 0, and
    only those without a letter are rejected. Ties go to the smaller name."""
    names = [free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_rejected")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, text):
            data, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
            known = _lettered(data, offsets)
            label, score, reject = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), ~known
            if model is not None and known.any():
                p = _softmax(logits(model, data, offsets) / model.temperature)
                best = p.argmax(axis=1)
                label[known] = np.array(model.languages, object)[best[known]]
                score[known] = np.clip(p[np.arange(len(p)), best][known], 0, 1)
                reject |= score < model.reject_below
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(reject)], names=[*batch.schema.names, *names])

    return map_batches(docs, predict, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that no training sees: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def language_report(docs: DataFrame, rules: LangRules | None = None) -> DataFrame:
    """One row per document: doc_id, held_out (null for a null doc_id),
    lang_pred, score, rejected."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), rules)
    told = identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_identified(docs: DataFrame, rules: LangRules | None = None) -> DataFrame:
    """``docs`` without those whose language is rejected."""
    told = identify(docs, train(docs.filter(~held_out(F.col("doc_id"))), rules))
    return told.filter(~F.col(told.columns[-1])).select(*docs.columns)
