"""Repeats of a least length in bytes across documents, by run-length indexes.

1. Every window of the least length has a key: the smallest hash of the grams in it.
   Runs of windows with one key are pieces of a text; equal windows have equal keys,
   so all that can match meets under a key. Grams that a bounded sample of documents
   shows to be common are taken only in windows without any other, so a line that a
   third of the documents hold keeps its key for itself and not for what surrounds it.
2. Tasks settle what repeats among their own documents and send packed key, content
   hash and place of the rest to buckets of keys. A key with one content needs no
   search: the first document keeps it. Of a key with several contents each content
   is kept once, with its first document. Two of them can share a window only if they
   also agree in one of a few stretches around the key's gram, of which any window with
   it holds one; hashes of these tell which contents need a search, and their text is
   fetched. So pieces that share little more than a gram are not searched.
3. Each bucket of such pieces becomes a run-length index (``runindex``), through which
   matching statistics of pieces of later documents are streamed.
4. The spans of a document come together with its text.

No group of copies meets in one task: a task sends a content once at most. A key
with very many contents is dealt out again by the windows' own hashes; equal windows
are merged before they get to an index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import _BYTE, _STEP, CHUNK_BYTES, Scratch, byte_column, chunks, map_batches, mix
from tidemill.llm.runindex import WORD, Strings, repeats_of_earlier

_TOP = np.uint64(1 << 63)
#: Hashes of a piece's stretches: 0 if one is not whole, _OPEN if the gram is there twice.
_OPEN = np.uint16((1 << 16) - 1)
#: Stretches of a piece.
STRETCHES = 4


@dataclass(frozen=True)
class RepeatRules:
    """Least length of a match and of the keys' grams in bytes; how many documents
    the sample for common grams has, in how many of them a gram is common, and how
    many common grams are used at most (these only choose among keys that are all
    right); bytes of text that a task gathers before it sends, and that go to a
    bucket; bytes of pieces in an index, about; contents of a key beyond which its
    windows are dealt out by themselves."""

    least: int = 50
    gram: int = 20
    sample: int = 1024
    common: int = 8
    most_common: int = 1 << 16
    gather_bytes: int = 8 << 20
    bucket_bytes: int = 8 << 20
    index_bytes: int = 1 << 19
    split: int = 1 << 12

    def __post_init__(self):
        if not 0 < self.gram <= self.least or not WORD < self.least <= 8 * WORD:
            raise ValueError(f"a match has {WORD + 1} to {8 * WORD} bytes, a gram no more than a match")

    @property
    def reach(self) -> int:
        """Grams, and so windows of a piece at most."""
        return self.least - self.gram + 1

    @property
    def stretches(self) -> list[tuple[int, int]]:
        """Bytes to the left and right of a gram, such that any window with the gram has
        those of a pair at least."""
        edges = [k * self.reach // STRETCHES for k in range(STRETCHES + 1)]
        return [(a, self.reach - b) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=4)
def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes, joined from hashes of powers of two."""
    power = lambda k: np.uint64(pow(_STEP, k, 1 << 64))
    part, width, out, covered = _BYTE[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, covered = part, width
            else:
                n = len(data) - covered - width + 1
                out, covered = out[:n] + part[covered : covered + n] * power(covered), covered + width
        if covered == size:
            return mix(out)
        n = len(part) - width
        part, width = part[:n] + part[width:] * power(width), 2 * width


def sliding_least(values: np.ndarray, size: int, least=np.minimum) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        values, width = least(values[:-width], values[width:]), 2 * width
    return least(values[: len(values) - size + width], values[size - width :]) if width < size else values


def _gram_places(grams: np.ndarray, keys: np.ndarray, reach: int, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the first and the last place of its key's gram; ``keys`` are those
    of all windows."""
    none = np.zeros(reach - 1, np.uint64)
    hit = sliding_least(np.concatenate([none, keys, none]), reach, np.maximum) == grams
    places, before = np.flatnonzero(hit), np.concatenate([[0], np.cumsum(hit)])
    low = before[start]
    many = before[start + windows + reach - 1] - low
    piece = np.repeat(np.arange(len(start)), many)
    at = places[np.arange(len(piece)) + np.repeat(low - np.cumsum(many) + many, many)]
    own = np.flatnonzero(grams[at] == keys[start][piece])
    at, piece = at[own], piece[own]
    edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True])
    return at[edge[:-1]], at[edge[1:] - 1]


def cut(data: np.ndarray, offsets: np.ndarray, rules: RepeatRules, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of some texts: ``(text, start, windows, key, content hash, hashes of the
    stretches around the key's gram)``."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none, *(none.astype(np.uint64) for _ in range(2 + STRETCHES))
    if len(data) < rules.least:
        return nothing
    room = 1 << int(len(data)).bit_length()
    back = _power_table(pow(_STEP, -1, 1 << 64), room)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_STEP, room)[: len(data)], out=total[1:])
    # As gram_hashes.
    grams = mix((total[rules.gram :] - total[: -rules.gram]) * back[: len(data) - rules.gram + 1]) >> np.uint64(1)
    if len(common):
        known = np.zeros(1 << 20, bool)
        known[common >> np.uint64(43)] = True
        may = np.flatnonzero(known[grams >> np.uint64(43)])
        at = np.minimum(np.searchsorted(common, grams[may]), len(common) - 1)
        grams[may[common[at] == grams[may]]] |= _TOP
    keys = sliding_least(grams, rules.reach)
    # Runs of one key, cut where texts begin and where their last windows have begun.
    tail = np.maximum(offsets[1:] - rules.least + 1, offsets[:-1])
    edge = np.ones(len(keys), bool)
    edge[1:] = keys[1:] != keys[:-1]
    for places in (offsets[:-1], tail):
        edge[places[places < len(keys)]] = True
    start = np.flatnonzero(edge)
    windows = np.diff(np.r_[start, len(keys)])
    text = np.searchsorted(offsets, start, side="right") - 1
    whole = start < tail[text]
    start, windows, text = start[whole], windows[whole], text[whole]
    if not len(start):
        return nothing
    parts = -(-windows // rules.reach)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start, text = np.repeat(start, parts) + part * rules.reach, np.repeat(text, parts)
    windows = np.minimum(np.repeat(windows, parts) - part * rules.reach, rules.reach)
    key, end = keys[start], start + windows + rules.least - 1
    content = mix((total[end] - total[start]) * back[start] + windows.astype(np.uint64))
    first, last = _gram_places(grams, keys, rules.reach, start, windows)

    sides = []
    for left, right in rules.stretches:
        a, b = first - left, first + rules.gram + right
        whole = np.flatnonzero((a >= start) & (b <= end))
        side = np.zeros(len(start), np.uint16)
        side[whole] = np.clip(mix((total[b[whole]] - total[a[whole]]) * back[a[whole]]) >> np.uint64(48), 1, _OPEN - 1)
        side[first < last] = _OPEN
        sides.append(side)
    return text, start - offsets[text], windows, mix(key), content, *sides


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(doc, mark, bytes, offsets, place of the first byte)`` of texts, or of
    overlapping stretches of a long one."""
    for batch in chunks(batches, "text"):
        doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = byte_column(batch.column(2))
        if len(data) <= 2 * CHUNK_BYTES or batch.num_rows > 1:
            yield doc, mark, data, offsets, 0
            continue
        for a in range(0, len(data), CHUNK_BYTES):
            part = data[a : a + CHUNK_BYTES + 64]
            yield doc, mark, part, np.array([0, len(part)]), a


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, int(np.frombuffer(blob, np.int64, 1)[0]) + 1)[1:]
    at, out = 8 * (len(sizes) + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _bytes_of(x: np.ndarray, n: int) -> np.ndarray:
    """The lower ``n`` bytes of each value, all lowest bytes first."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T


def _values_of(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = x.reshape(n, -1).T
    return out.view("<u8").ravel()


def merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, in order, overlapping and touching ones joined."""
    if not len(doc):
        return doc, mark, start, end
    by = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[by], mark[by], start[by], end[by]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    lift = np.cumsum(other) * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + lift)
    new = other.copy()
    new[1:] |= (start + lift)[1:] > far[:-1]
    begin = np.flatnonzero(new)
    return doc[begin], mark[begin], start[begin], (far - lift)[np.r_[begin[1:] - 1, len(doc) - 1]]


_FOUND = "doc long, mark long, starts array<long>, ends array<long>, key long, windows int, split boolean"
_FOUND_ARROW = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("key", pa.int64()), ("windows", pa.int32()), ("split", pa.bool_())])


def _lists(begin: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[begin, len(values)].astype(np.int32)), pa.array(values.astype(np.int64)))


def _span_rows(doc, mark, start, end) -> pa.RecordBatch:
    """One row a document, with its merged spans."""
    doc, mark, start, end = merged(doc, mark, start, end)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    begin = np.flatnonzero(new)
    n = len(begin)
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(mark[begin]), _lists(begin, start), _lists(begin, end), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], schema=_FOUND_ARROW)


def _common_grams(docs: DataFrame, rules: RepeatRules, count: int) -> np.ndarray:
    """Hashes (sorted) of grams that many documents of a bounded sample hold."""

    def grams(batches):
        for doc, _, data, offsets, _ in _texts(batches):
            if len(data) < rules.gram:
                continue
            hashed = gram_hashes(data, rules.gram) >> np.uint64(1)
            text = np.repeat(np.arange(len(doc)), np.diff(offsets))[: len(hashed)]
            whole = np.arange(len(hashed)) + rules.gram <= offsets[text + 1]
            pair = np.unique(np.rec.fromarrays([hashed[whole], text[whole]]))
            yield pa.RecordBatch.from_arrays([pa.array(pair.f0.astype(np.int64))], names=["gram"])

    some = docs.filter(F.rand(29) < min(1.0, rules.sample / max(count, 1)))
    held = map_batches(some, grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.common)
    rows = held.orderBy(F.desc("n"), "gram").limit(rules.most_common).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy().astype(np.uint64))


def _sender(rules: RepeatRules, common: np.ndarray, buckets: int):
    """Cuts texts; settles what repeats among the texts gathered, sends the rest."""

    def send(parts):
        doc, mark, start, windows, key, content, *sides = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        both = key ^ (content * np.uint64(_STEP))
        by = np.argsort(both)
        begin = np.flatnonzero(np.r_[True, both[by][1:] != both[by][:-1]])
        least = np.minimum.reduceat(doc[by], begin)
        later = np.empty(len(doc), bool)
        later[by] = doc[by] > np.repeat(least, np.diff(np.r_[begin, len(doc)]))
        gone = merged(doc[later], mark[later], start[later], start[later] + windows[later] + rules.least - 1)
        gone_to = (mix(gone[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        kept = np.flatnonzero(~later)
        to = ((key[kept] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(to, kind="stable")  # documents stay together, as they were read
        kept, to = kept[by], to[by]
        gone_by = np.argsort(gone_to, kind="stable")
        gone = [x[gone_by] for x in gone]
        buckets_up = np.arange(buckets + 1)
        edges, gone_edges = np.searchsorted(to, buckets_up), np.searchsorted(gone_to[gone_by], buckets_up)
        doc, mark = doc[kept], mark[kept]
        new = np.ones(len(kept), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (to[1:] != to[:-1])
        at = np.flatnonzero(new)
        of_doc = doc[at], mark[at], np.diff(np.r_[at, len(kept)]).astype(np.uint32)
        doc_edges = np.searchsorted(at, edges)
        pieces = _bytes_of(key[kept], 6), _bytes_of(content[kept], 6), _bytes_of(start[kept], 4), windows[kept].astype(np.uint8), *(x[kept] for x in sides)
        used = np.flatnonzero((np.diff(edges) > 0) | (np.diff(gone_edges) > 0))
        blobs = []
        for b in used.tolist():
            d, i, g = (slice(x[b], x[b + 1]) for x in (doc_edges, edges, gone_edges))
            blobs.append(_packed(*(x[d] for x in of_doc), *(x[..., i] for x in pieces), *(x[g] for x in gone)))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "pieces"])

    def run(batches):
        parts, held = [], 0
        for doc, mark, data, offsets, base in _texts(batches):
            text, start, *rest = cut(data, offsets, rules, common)
            if len(text):
                parts.append((doc[text], mark[text], start + base, *rest))
                held += len(data)
            if held >= rules.gather_bytes:
                yield send(parts)
                parts, held = [], 0
        if parts:
            yield send(parts)

    return run


def _linked(key: np.ndarray, doc: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """Whether a content of another document under the key has a stretch of the content
    too. Where any piece of a key holds the gram twice, all of the key are linked."""
    out = np.isin(key, np.unique(key[sides[0] == _OPEN]))
    for side in sides:
        has = np.flatnonzero(side)
        if len(has):
            both = key[has] | (side[has].astype(np.uint64) << np.uint64(48))
            by = np.argsort(both)
            begin = np.flatnonzero(np.r_[True, both[by][1:] != both[by][:-1]])
            docs = doc[has][by]
            shared = np.minimum.reduceat(docs, begin) < np.maximum.reduceat(docs, begin)
            out[has[by]] |= np.repeat(shared, np.diff(np.r_[begin, len(has)]))
    return out


def _resolver(rules: RepeatRules):
    """Of a bucket: spans that are settled, and the pieces whose text is needed."""

    def resolve(bucket: pa.Table) -> pa.Table:
        parts, gone = [], []
        for blob in bucket.column("pieces").to_pylist():
            doc, mark, counts, key, content, start, windows, *rest = _unpacked(blob, np.int64, np.int64, np.uint32, *[np.uint8] * 4, *[np.uint16] * STRETCHES, *[np.int64] * 4)
            parts.append((np.repeat(doc, counts), np.repeat(mark, counts), _values_of(start, 4).astype(np.int64), windows.astype(np.int64), _values_of(key, 6), _values_of(content, 6), *rest[:STRETCHES]))
            gone.append(rest[STRETCHES:])
        columns = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        gone = [np.concatenate(x) for x in zip(*gone)]
        by = np.argsort(columns[4])
        same = columns[4][by][1:] == columns[4][by][:-1]
        # Of a key that comes once nothing is to be told.
        by = by[np.r_[False, same] | np.r_[same, False]] if len(by) else by
        columns = [x[by] for x in columns]
        by = np.lexsort((*columns[2::-1], columns[5], columns[4]))
        doc, mark, start, windows, key, content, *sides = (x[by] for x in columns)
        of_key = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        of_content = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])][: len(key)])
        if not len(key):
            return pa.Table.from_batches([_span_rows(*gone)])
        each = lambda value, begin: np.repeat(value, np.diff(np.r_[begin, len(key)]))
        first = each(doc[of_content], of_content)  # by place in the sort, the least
        spread = np.minimum.reduceat(doc, of_key) < np.maximum.reduceat(doc, of_key)
        contents = np.diff(np.r_[np.searchsorted(of_content, of_key), len(of_content)])
        later = doc > first
        gone = [np.concatenate([x, y[later]]) for x, y in zip(gone, (doc, mark, start, start + windows + rules.least - 1))]
        ask = np.flatnonzero(each(spread & (contents > 1), of_key) & ~later)
        ask = ask[_linked(key[ask], doc[ask], [x[ask] for x in sides])]
        out = [_span_rows(*gone)]
        if len(ask):
            new = np.ones(len(ask), bool)
            new[1:] = (key[ask][1:] != key[ask][:-1]) | (content[ask][1:] != content[ask][:-1]) | (mark[ask][1:] != mark[ask][:-1])
            at = np.flatnonzero(new)
            i = ask[at]
            own = np.flatnonzero(np.r_[True, key[i][1:] != key[i][:-1]])
            contents = np.diff(np.r_[own, len(i)])
            many = np.repeat(contents > rules.split, contents)
            wide = key[i] | (np.uint64(int(bucket.column("bucket")[0].as_py()) & 0x7FFF) << np.uint64(48))
            out.append(pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(mark[i]), _lists(at, start[ask]), pa.nulls(len(i), pa.list_(pa.int64())), pa.array(wide.astype(np.int64)), pa.array(windows[i].astype(np.int32)), pa.array(many)], schema=_FOUND_ARROW))
        return pa.Table.from_batches(out)

    return resolve


_ASKED = "key long, doc long, mark long, starts array<long>, text binary"


def _fetcher(rules: RepeatRules):
    """The texts of the pieces asked for; of a split key, those of its windows."""

    def fetch(batches):
        for batch in chunks(batches, "text"):
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = byte_column(batch.column(2))
            asked = batch.column(3)
            counts = pc.list_value_length(asked).to_numpy()
            text = np.repeat(np.arange(batch.num_rows), counts)
            rows = asked.flatten()
            key, windows, split, starts = (pc.struct_field(rows, n) for n in ("key", "windows", "split", "starts"))
            key, windows, split = key.to_numpy(), windows.to_numpy().astype(np.int64), split.to_numpy(zero_copy_only=False)
            many = pc.list_value_length(starts).to_numpy().astype(np.int64)
            places = starts.flatten().to_numpy()
            begin = np.cumsum(many) - many
            # Pieces, of which those of split keys become one for each window.
            copies = np.where(split, windows, 1)
            piece = np.repeat(np.arange(len(key)), copies)
            shift = np.arange(len(piece)) - np.repeat(np.cumsum(copies) - copies, copies)
            size = np.where(split[piece], 1, windows[piece]) + rules.least - 1
            at = offsets[text[piece]] + places[begin[piece]] + shift
            ends = np.cumsum(size)
            inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
            body = data[np.repeat(at, size) + inside]
            own = key[piece].copy()
            apart = np.flatnonzero(split[piece])
            if len(apart):
                own[apart] = gram_hashes(body, rules.least)[(ends - size)[apart]].astype(np.int64)
            total = np.cumsum(many[piece])
            inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - many[piece], many[piece])
            all_places = places[np.repeat(begin[piece], many[piece]) + inner] + np.repeat(shift, many[piece])
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(doc[text[piece]]), pa.array(mark[text[piece]]), _lists(total - many[piece], all_places), texts], names=["key", "doc", "mark", "starts", "text"])

    return fetch


def _later_windows(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Strings of one window that equal one of an earlier document under their key."""
    one = np.flatnonzero(np.diff(offsets) == least)
    if not len(one):
        return one
    one = one[np.lexsort((doc[one], key[one]))]
    begin = np.flatnonzero(np.r_[True, key[one][1:] != key[one][:-1]])
    first = np.repeat(one[begin], np.diff(np.r_[begin, len(one)]))
    later = doc[one] > doc[first]
    one, first = one[later], first[later]
    window = np.lib.stride_tricks.sliding_window_view(data, least)
    return one[(window[offsets[one]] == window[offsets[first]]).all(axis=1)]


def _matcher(rules: RepeatRules):
    """Spans of a bucket's pieces that earlier documents hold under the same key. Equal
    windows of a split key are told by comparing them with the first; the index gets
    that one, and nothing of a key that is left with one document."""

    def match(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        texts = bucket.column("text")
        data, offsets = byte_column(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
        key, doc, mark = (bucket.column(x).to_numpy() for x in ("key", "doc", "mark"))
        lists = bucket.column("starts").combine_chunks()
        many, places = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()
        begin = np.cumsum(many) - many

        def spans(string: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
            owner = np.repeat(string, many[string])
            total = np.cumsum(many[string])
            inner = np.arange(len(owner)) - np.repeat(total - many[string], many[string])
            start = places[np.repeat(begin[string], many[string]) + inner] + np.repeat(window, many[string])
            return doc[owner], mark[owner], start, start + rules.least

        later = _later_windows(data, offsets, key, doc, rules.least)
        left = np.ones(len(key), bool)
        left[later] = False
        by = np.flatnonzero(left)
        by = by[np.lexsort((doc[by], key[by]))]
        k, d = key[by], doc[by]
        new_key = np.r_[True, k[1:] != k[:-1]]
        step = np.r_[True, d[1:] != d[:-1]] & ~new_key
        run = np.cumsum(step)
        size = np.diff(np.r_[np.flatnonzero(new_key), len(k)])
        group, rank = np.cumsum(new_key) - 1, run - np.repeat(run[new_key], size)
        several = (np.maximum.reduceat(rank, np.flatnonzero(new_key)) > 0)[group]
        by, group, rank = by[several], group[several], rank[several]
        size = np.diff(offsets)[by]
        ends = np.cumsum(size)
        body = data[np.repeat(offsets[by] - ends + size, size) + np.arange(int(size.sum()))]
        string, window = repeats_of_earlier(Strings(body, np.r_[0, ends]), group, rank, rules.least)
        found = zip(spans(later, np.zeros(len(later), np.int64)), spans(by[string], window))
        return pa.Table.from_batches([_span_rows(*(np.concatenate(x) for x in found))])

    return match


def _spans(documents: DataFrame, rules: RepeatRules, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """As ``repeat_spans``, and whether ids repeat."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("doc is not null")
    repeated = not docs.groupBy("doc").count().filter("count > 1").isEmpty()
    docs = docs.select("doc", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("mark"), "text")
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    scratch = Scratch(spark)
    long_enough = docs.filter(F.octet_length("text") >= rules.least)
    common = _common_grams(long_enough, rules, size["n"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // rules.bucket_bytes))
    sent = map_batches(long_enough, _sender(rules, common, buckets), "bucket int, pieces binary")
    found = scratch.saved(sent.groupBy("bucket").applyInArrow(_resolver(rules), _FOUND), "settled", merge=False)
    scratch.forget()
    pieces = found.filter("key is not null")
    asked = pieces.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "windows", "split", "starts")).alias("asked"))
    with_text = docs.join(asked, ["doc", "mark"]).select("doc", "mark", "text", "asked")
    parts = max(1, -(-pieces.count() * 2 * rules.least // rules.index_bytes))
    fetched = map_batches(with_text, _fetcher(rules), _ASKED).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(parts)))
    matched = scratch.saved(fetched.groupBy("bucket").applyInArrow(_matcher(rules), _FOUND), "matched", merge=False)
    scratch.forget()
    spans = found.filter("key is null").union(matched).groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    return spans, repeated


def repeat_spans(documents: DataFrame, rules: RepeatRules | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, mark, starts, ends)``: for each document with any, the byte spans (end
    exclusive, merged by part of the search only: they may overlap) covered by strings
    of the least length that begin in a document with a smaller id too. ``mark`` is a
    hash of the text where ids repeat, else 0.

    Null texts are empty. Rows without id neither lose bytes nor count as sources. Rows
    with one id are judged each against smaller ids, not against each other. Other
    columns are not read; an empty table gives no rows."""
    return _spans(documents, rules or RepeatRules(), doc_id, text)[0]


def repeat_report(documents: DataFrame, rules: RepeatRules | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)`` of every row:
    bytes of the text, bytes covered by repeats of documents with smaller ids, maximal
    covered runs, digest of what is left, the runs as ``start:end`` by commas, and
    what is left (bytes). Cases as in ``repeat_spans``; a null id has no repeats."""
    rules = rules or RepeatRules()
    spans, repeated = _spans(documents, rules, doc_id, text)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    on = (F.col("doc_id").cast("long") == spans["doc"]) & (spans["mark"] == F.xxhash64("text") if repeated else F.lit(True))
    joined = docs.join(spans, on, "left").select("doc_id", "text", "starts", "ends")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(batches):
        for batch in chunks(batches, "text"):
            data, offsets = byte_column(batch.column(1))
            rows: list[tuple] = []
            for i, (starts, ends) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = data[offsets[i] : offsets[i + 1]]
                none = np.zeros(len(starts or ()), np.int64)
                _, _, s, e = merged(none, none, np.array(starts or (), np.int64), np.array(ends or (), np.int64))
                left = np.concatenate([own[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(own)])]).tobytes()
                rows.append((len(own), len(own) - len(left), len(s), hashlib.sha256(left).hexdigest(), ",".join(f"{a}:{b}" for a, b in zip(s.tolist(), e.tolist())), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return map_batches(joined, report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary")
