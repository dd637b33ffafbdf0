"""Secret scans: pattern spans plus a sliding-window entropy detector.

Candidate strings are runs of ``[A-Za-z0-9+/_=-]``. A window of fixed width
slides over each; the Shannon entropy of its characters is kept up to date from
the counts of the one character that enters and the one that leaves. Windows at
or over the threshold of the candidate's character class join to one span.
Allow-listed candidates (identifiers, paths, plain words) give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chunks, free_name, map_batches

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Candidates that look random yet are public by nature.
ALLOW = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    r"[A-Za-z]+(?:[-_/][A-Za-z]+)*",  # words, with or without joints
    r"/?[a-z0-9_]+(?:/[a-z0-9_]+)+/?",  # lower-case path
    r".*(?i:example|placeholder|changeme).*",
)


@dataclass(frozen=True)
class EntropyRules:
    """Window width in characters, the least candidate length, and bits per
    character from which a window of each class counts."""

    window: int = 20
    least: int = 20
    bits: dict[str, float] = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.7, "base64": 3.9})
    allow: tuple[str, ...] = ALLOW


def char_class(candidate: str) -> str | None:
    """hex, alnum or base64; None if it has no digit or no letter."""
    if not any(c.isdigit() for c in candidate) or not any(c.isalpha() for c in candidate):
        return None
    if all(c in "0123456789abcdef" for c in candidate) or all(c in "0123456789ABCDEF" for c in candidate):
        return "hex"
    return "alnum" if candidate.isalnum() else "base64"


def hot_windows(candidate: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined ``(start, end)`` of the windows whose entropy is ``bits`` or more.

    ``total`` is the sum of n*log2(n) over the window's character counts, so
    entropy is ``log2(width) - total / width``; each shift changes two terms."""
    table = [0.0, 0.0, *(n * log2(n) for n in range(2, width + 2))]
    counts: dict[str, int] = {}
    total, top, spans = 0.0, log2(width), []
    for at, char in enumerate(candidate):
        n = counts.get(char, 0)
        total += table[n + 1] - table[n]
        counts[char] = n + 1
        if at >= width:
            gone = candidate[at - width]
            n = counts[gone]
            total += table[n - 1] - table[n]
            counts[gone] = n - 1
        if at >= width - 1 and top - total / width >= bits - 1e-9:
            start = at - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [(a, b) for a, b in spans]


class Scanner:
    """Finds the spans of one text; offsets are code points, ends exclusive."""

    def __init__(self, rules: EntropyRules):
        self.rules = rules
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{max(rules.least, rules.window)},}}")
        self.allow = re.compile("|".join(f"(?:{x})" for x in rules.allow)) if rules.allow else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in self.candidate.finditer(text):
            word = m[0]
            kind = char_class(word)
            if kind is None or self.allow and self.allow.fullmatch(word):
                continue
            found += [(m.start() + a, 3, m.start() + b) for a, b in hot_windows(word, self.rules.window, self.rules.bits[kind])]
        return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, rules: EntropyRules | None = None, text: str = "text", mask: str | None = None) -> DataFrame:
    """``docs`` with ``secret_counts`` (array of longs, one for each of KINDS),
    ``secret_base`` and ``secret_spans`` (``kind:start:end``, comma-joined).

    A null text has no spans. With ``mask``, secrets in the text column are
    replaced by it (null stays null). A name that clashes gets an underscore in
    front. Rows are independent: one pass over each whole text, no shuffle."""
    rules = rules or EntropyRules()
    names = [free_name(docs, x) for x in ("secret_counts", "secret_base", "secret_spans")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in chunks(batches, text):
            where = batch.schema.get_field_index(text)
            counts, base, every, masked = [], [], [], []
            for value in batch.column(where).to_pylist():
                body = value or ""
                plain = sorted(scanner.base(body))
                spans = sorted(plain + scanner.entropy(body))
                n = [0] * len(KINDS)
                for _, k, _ in spans:
                    n[k] += 1
                counts.append(n)
                base.append(_joined(plain))
                every.append(_joined(spans))
                if mask is not None:
                    masked.append(_masked(value, spans, mask) if spans else value)
            columns = list(batch.columns)
            if mask is not None:
                columns[where] = pa.array(masked, batch.schema.field(where).type)
            columns += [pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return map_batches(docs, scan, schema)


def secret_report(docs: DataFrame, rules: EntropyRules | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy,
    base_sha256 (of the base spans) and spans. Repeated rows give repeated rows;
    an empty or null text gives zeros and the digest of the empty string."""
    found = find_secrets(docs.select("doc_id", "text"), rules)
    return found.select(
        "doc_id",
        *(F.col("secret_counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.col("secret_base"), 256).alias("base_sha256"),
        F.col("secret_spans").alias("spans"),
    )


def mask_secrets(docs: DataFrame, rules: EntropyRules | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` masked; ``n_chars``, if there, counts anew."""
    out = find_secrets(docs, rules, mask=mask).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


