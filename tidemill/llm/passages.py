"""Passages that repeat across documents, by compact windows.

Every text is a sequence of word shingles. For each of several hash functions the
Cartesian tree of the hashes cuts it into compact windows ``[l, r]`` around a
minimum ``c``: all subsequences in ``[l, r]`` that hold c share c's min-hash. Only
windows that can hold a passage of the least length count; about ``2 n / t`` of them
stay. Windows of equal min-hash meet at one representative, the first document of
the group. A pair is verified on its whole sequences if in two hash functions or more
its windows overlap by the least length, or if a group has no other members.

A representative may hold the minimum in another context, as a frequent line has
many. So all members of a group with an unverified one meet again under more special
keys, at the same minima: the minimum together with the least hashes, by several
functions, of the stretch before or after it, half the least passage long. A passage
covers one of the two stretches whatever its minimum's place, and least hashes bear
edits. No group emits all its pairs; each key of a window emits one pair at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, byte_column, chunks, map_batches, mix, shingles, word_hashes


@dataclass(frozen=True)
class PassageRules:
    """Shingle width and least passage in words, similarity in hundredths, hash
    functions, and those that must agree at first if others hold the minimum too;
    what agrees in fewer meets again. A
    passage of similarity 0.8 agrees in one or more of five with a chance of
    0.9997, in two or more with 0.993, an exact one in all."""

    width: int = 5
    least_words: int = 50
    percent: int = 80
    hashes: int = 5
    need: int = 2

    def __post_init__(self):
        if not 1 <= self.need <= self.hashes <= 8:
            raise ValueError("1 to 8 hash functions (a key names its own in 3 bits), and no more of them needed than there are")

    @property
    def least(self) -> int:
        """Least passage in shingles."""
        return self.least_words - self.width + 1


#: Ids up to this number are broadcast to fetch sequences; more are shuffled.
SMALL_IDS = 1_000_000
#: Parts, by the representative, in which the pairs of the first meeting are verified; their sequences are on the disks one part at a time.
PARTS = 2
#: Lengths of the stretches beside a minimum, in halves of the least passage; one hash function each.
BESIDE = (1, 2, 2, 2)


def _least(value: np.ndarray, size: int) -> np.ndarray:
    """The least value of each stretch of ``size``."""
    span = 1
    while span < size:
        step = min(span, size - span)
        value = np.minimum(value[: max(len(value) - step, 0)], value[step:])
        span += step
    return value


def _smaller(value: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place ``at`` of the values the next one with a smaller value before it
    (``step`` -1) or after it (1); other places hold a value below all. What a larger
    value has passed over is larger, too, so its pointer is taken on."""
    to = np.arange(len(value)) + step
    i, mine, other = at, value[at], at + step
    while len(i):
        larger = value[other] > mine
        i, mine, other = i[larger], mine[larger], to[other[larger]]
        to[i] = other
    return to[at]


def compact_windows(doc: np.ndarray, value: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum, left and right end (indexes into ``value``) of each compact window
    of ``least`` or more elements; ``doc`` tells the sequences apart.

    A window is that long if and only if its minimum is the minimum of some stretch
    of ``least`` elements; those minima come from a sliding window, and a stack over
    them alone gives the ends, for whatever bounds such a window has a longer one."""
    n = len(value)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    # The lowest bits, as many as the length asks for, give way to the position.
    bits = np.uint64(int(n).bit_length())
    low = (value >> bits << bits) | np.arange(n, dtype=np.uint64)
    best = _least(low, least)
    inside = doc[: n - least + 1] == doc[least - 1 :]
    chosen = np.zeros(n, bool)
    chosen[(best[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    if not len(place):
        return none, none, none
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    begin = edge[np.searchsorted(edge, place, side="right") - 1]
    following = np.r_[edge[1:], n]
    end = following[np.searchsorted(edge, place, side="right") - 1] - 1
    # The minima with a value below all around those of each sequence.
    at = np.arange(1, len(place) + 1)
    at[1:] += np.cumsum(begin[1:] != begin[:-1])
    spaced, spot = np.zeros(at[-1] + 2, np.uint64), np.full(at[-1] + 2, -1)
    spaced[at], spot[at] = low[place], np.arange(len(place))
    before, after = (spot[_smaller(spaced, at, step)] for step in (-1, 1))
    return place, np.where(before < 0, begin, place[before] + 1), np.where(after < 0, end, place[after] - 1)


_WINDOW, _WINDOW_NAMES = "key long, doc_id long, place long", ["key", "doc_id", "place"]
#: Bits of a distance in ``place``. Windows of minima so far apart are told not to overlap;
#: a passage that long has other minima in between.
_NEAR = 16
#: Rows of one Arrow batch of windows.
_WINDOWS = 200_000


def _shingled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    doc, word, _, _ = word_hashes(*byte_column(column))
    return shingles(doc, word, width, whole_if_short=False)


def _hashed(value: np.ndarray, f: int) -> np.ndarray:
    return mix(value + np.uint64((f + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _keys(hashed: np.ndarray, f: int) -> np.ndarray:
    return (hashed >> np.uint64(3) << np.uint64(3) | np.uint64(f)).view(np.int64)


def windows(docs: DataFrame, rules: PassageRules) -> DataFrame:
    """``(key, doc_id, place)``: the hash function is in the key's last 3 bits;
    ``place`` packs the minimum's shingle and its distances to both ends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids = batch.column(0).to_numpy()
            doc, value = _shingled(batch.column(1), rules.width)
            starts = np.searchsorted(doc, np.arange(batch.num_rows))
            for f in range(rules.hashes):
                hashed = _hashed(value, f)
                at, left, right = compact_windows(doc, hashed, rules.least)
                owner = doc[at]
                far = (1 << _NEAR) - 1
                place = (at - starts[owner]) << 2 * _NEAR | np.minimum(at - left, far) << _NEAR | np.minimum(right - at, far)
                for k in range(0, len(at), _WINDOWS):
                    part = slice(k, k + _WINDOWS)
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(hashed[at[part]], f)), pa.array(ids[owner[part]]), pa.array(place[part])], names=_WINDOW_NAMES)

    return map_batches(docs.select("doc_id", "text"), cut, _WINDOW)


def _met(rows: DataFrame, keep: Scratch) -> DataFrame:
    """``rows(key, doc_id, ...)`` of groups of several documents, with the first
    document ``other_id`` of their group and whether it is a ``couple``: two rows. Groups are
    aggregated on the map side and saved, so that Spark can split the join back at a
    key that a third of the documents share."""
    group = rows.groupBy("key").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("other_id < last")
    group = keep.saved(group.select("key", "other_id", (F.col("n") == 2).alias("couple")), "groups")
    keep.forget()  # the rows are not shuffled twice on the disks
    return rows.join(group.hint("shuffle_hash"), "key")  # the rows need no sorting


def _sequences(docs: DataFrame, ids: DataFrame, rules: PassageRules) -> DataFrame:
    """``(doc_id, mine, theirs, shingles)`` of the documents ``ids(doc_id, mine, theirs)``; of rows
    that repeat a doc_id each. 32 bits of a shingle's hash tell those of two texts apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            owner, value = _shingled(batch.column(1), rules.width)
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            short = (value >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(short))], names=["doc_id", "mine", "theirs", "shingles"])

    # Ids are 16 bytes each; up to SMALL_IDS, counted first, they are broadcast.
    few = ids.count() <= SMALL_IDS
    return map_batches(docs.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text", "mine", "theirs"), cut, "doc_id long, mine int, theirs int, shingles array<int>")


def _balance(hit: np.ndarray, percent: int) -> np.ndarray:
    """Running balance of hits against misses, from 0."""
    out = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(np.where(hit, 100 - percent, -percent), out=out[1:])
    return out


def _segment(score: np.ndarray, at: int) -> tuple[int, int]:
    """The stretch around ``at`` with the best balance."""
    start = at - int(score[: at + 1][::-1].argmin())
    return start, at + 1 + int(score[at + 1 :].argmax())


def _run(a: np.ndarray, b: np.ndarray, at: int, other: int, least: int) -> tuple | None:
    """The exact run through an anchor, if it has ``least`` shingles."""
    n, m = min(len(a) - at, len(b) - other), min(at, other)
    ahead = a[at : at + n] != b[other : other + n]
    ahead = int(ahead.argmax()) if ahead.any() else n
    back = a[at - m : at][::-1] != b[other - m : other][::-1]
    back = int(back.argmax()) if back.any() else m
    return (at - back, at + ahead, other - back, other + ahead, 1.0) if back + ahead >= least else None


def _blocks(value: np.ndarray, least: int) -> np.ndarray:
    """A hash of each stretch of ``least`` shingles."""
    out, span = mix(value.astype(np.uint64) + np.uint64(1)), 1
    while span < least:
        step = min(span, least - span)
        out = out[: max(len(out) - step, 0)] * np.uint64(0xD6E8FEB86659FD93) + out[step:]
        span += step
    return mix(out)


def _distinct(value: np.ndarray) -> np.ndarray:
    value = np.sort(value)
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    return value[first]


def _among(value: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``distinct`` ones."""
    if not len(distinct):
        return np.zeros(len(value), bool)
    return distinct[np.minimum(np.searchsorted(distinct, value), len(distinct) - 1)] == value


class _Pair:
    """Finds the passages of two shingle sequences around anchors. Stretches that
    failed once are not tried again from another anchor inside them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rules: PassageRules):
        self.a, self.b, self.rules = a, b, rules
        both = np.sort(b.astype(np.uint64) << np.uint64(32) | np.arange(len(b), dtype=np.uint64))
        self.order, self.sorted = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.uint32)
        self.hit = _among(a, self.sorted)
        self.tried: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list]] = {}
        self.blocks: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @cached_property
    def score(self) -> np.ndarray:
        return _balance(self.hit, self.rules.percent)

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the stretch of a with the best balance around each shingle starts."""
        score = self.score
        return np.maximum.accumulate(np.where(score == np.minimum.accumulate(score), np.arange(len(score)), 0))

    @cached_property
    def ends(self) -> np.ndarray:
        """Where it ends."""
        score = self.score[:0:-1]
        best = np.where(score == np.maximum.accumulate(score), np.arange(len(score)), 0)
        return len(score) - np.maximum.accumulate(best)[::-1]

    def exact(self, at: int, places: np.ndarray) -> int | None:
        """The first of ``places`` in b that has an exact run of ``least`` shingles with
        ``a[at]`` in it: a stretch so long around them is the same in both."""
        least = self.rules.least
        if self.blocks is None:
            mine, theirs = _blocks(self.a, least), _blocks(self.b, least)
            self.blocks = mine, theirs, _among(mine, np.sort(theirs))
        mine, theirs, held = self.blocks
        back = at - max(at - least + 1, 0) - np.flatnonzero(held[max(at - least + 1, 0) : at + 1])
        if not len(back):
            return None
        begin = places[:, None] - back
        same = (begin >= 0) & (begin < len(theirs))
        same &= theirs[np.where(same, begin, 0)] == mine[at - back]
        found = same.any(axis=1)
        return int(places[found.argmax()]) if found.any() else None

    def passage(self, at: int) -> tuple | None:
        """(start, end, other start, other end, similarity) of the passage around
        ``a[at]``, in shingles; None if there is none."""
        a, b, rules = self.a, self.b, self.rules
        s, e = int(self.starts[at]), int(self.ends[at])
        if e - s < rules.least:
            return None
        if (s, e) not in self.tried:
            mine = _distinct(a[s:e])
            self.tried[s, e] = mine, _balance(_among(b, mine), rules.percent), []
        mine, score, failed = self.tried[s, e]
        places = self.order[self.sorted.searchsorted(a[at], "left") : self.sorted.searchsorted(a[at], "right")]
        left, known, first = places, False, None
        for s2, e2 in failed:
            left = left[(left < s2) | (left >= e2)]
        while True:
            if not known and not (len(left) and left[0] == places[0]):
                first, known = self.exact(at, places), True
                left = left if first is None else left[left <= first]
            if not len(left):
                return None if first is None else _run(a, b, at, first, rules.least)
            s2, e2 = _segment(score, int(left[0]))
            if e2 - s2 >= rules.least:
                theirs = _distinct(b[s2:e2])
                both = int(_among(theirs, mine).sum())
                every = len(mine) + len(theirs) - both
                if 100 * both >= rules.percent * every:
                    return s, e, s2, e2, both / every
            failed.append((s2, e2))
            left = left[(left < s2) | (left >= e2)]


_FOUND = "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double, failed array<long>"


def _list_of(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy().view(np.uint32)


def _overlap(function: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> bool:
    """Whether windows of two functions overlap by ``least``; of many windows it is
    taken for granted, for it only spares a verification."""
    if len(function) > 64:
        return True
    both = np.minimum.outer(right, right) - np.maximum.outer(left, left) + 1 >= least
    return bool((both & (function[:, None] != function)).any())


def _verified(pairs: DataFrame, sequences: DataFrame, firsts: DataFrame, rules: PassageRules) -> DataFrame:
    """Passages of ``pairs(doc_id, other_id, anchors(key, place), couple)``, in words; the
    keys of anchors that belong to none come as rows with a null start. ``firsts`` has the
    sequences of other_id. Unless a pair is a couple, windows of two hash functions
    must overlap by the least length."""
    theirs = firsts.select(F.col("doc_id").alias("other_id"), F.col("shingles").alias("other"))
    joined = pairs.join(sequences.select("doc_id", "shingles"), "doc_id").join(theirs, "other_id")
    width, far = rules.width, (1 << _NEAR) - 1

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, couples = (batch.column(k).to_pylist() for k in (0, 1, 5))
            out: list[tuple] = []
            failed: list[np.ndarray] = []
            for i in range(batch.num_rows):
                a, b = _list_of(batch.column(3), i), _list_of(batch.column(4), i)
                anchors = batch.column(2)[i].values
                key, place = (anchors.field(k).to_numpy() for k in range(2))
                at = place >> 2 * _NEAR
                if not couples[i] and not _overlap(key & 7, at - (place >> _NEAR & far), at + (place & far), rules.least):
                    failed.append(key)
                    continue
                order = np.argsort(at, kind="stable")
                order = order[at[order] < len(a)]  # others are of another text under this doc_id
                pair = _Pair(a, b, rules)
                # Around an anchor in a passage at least half as many shingles are shared as it must have.
                hits = np.zeros(len(a) + 1, np.int64)
                np.cumsum(pair.hit, out=hits[1:])
                x = at[order]
                near = hits[np.minimum(x + rules.least, len(a))] - hits[np.maximum(x - rules.least + 1, 0)] >= rules.least // 2
                failed.append(key[order[~near]])
                order, x, k = order[near], x[near], 0
                while k < len(x):
                    got = pair.passage(int(x[k]))
                    if got is None:
                        past = k + int(np.searchsorted(x[k:], x[k], side="right"))
                        failed.append(key[order[k:past]])
                        k = past
                    else:
                        s, e, s2, e2, similarity = got
                        k += int(np.searchsorted(x[k:], e))  # others are inside this passage
                        out.append((ids[i], s, e + width - 1, others[i], s2, e2 + width - 1, similarity, None))
            if failed:
                out.append((None, None, None, None, None, None, None, _distinct(np.concatenate(failed))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64() if k == 6 else pa.list_(pa.int64()) if k == 7 else pa.int64()) for k in range(8)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return map_batches(joined.select("doc_id", "other_id", "anchors", "shingles", "other", "couple"), check, _FOUND)


def _again(members: DataFrame, sequences: DataFrame, rules: PassageRules) -> DataFrame:
    """Windows ``members(doc_id, ats)`` under more special keys ``(key, doc_id, place)``.

    The minimum with the least hash of stretches on either side, of BESIDE lengths:
    a passage reaches half its length on one side at least."""
    half = rules.least // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ats, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            begins, ends = np.cumsum(size := pc.list_value_length(lists).to_numpy()) - size, np.cumsum(size)
            value = mix(lists.flatten().to_numpy().view(np.uint32).astype(np.uint64))
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ats).to_numpy())
            at = ats.flatten().to_numpy().astype(np.int64)
            inside = at < size[owner]  # others are of another text under this doc_id
            owner, at = owner[inside], at[inside]
            x = begins[owner] + at
            for f, halves in enumerate(BESIDE):
                span = halves * half
                least = _least(_hashed(value, f + 8), span)
                for start, ok in ((x - span, at >= span), (x + 1, x + span < ends[owner])):
                    key = mix(mix(value[x[ok]] + np.uint64(f + 1)) ^ least[start[ok]]).view(np.int64)
                    whose, place = ids[owner[ok]], at[ok] << 2 * _NEAR
                    for k in range(0, len(key), _WINDOWS):
                        part = slice(k, k + _WINDOWS)
                        yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(whose[part]), pa.array(place[part])], names=_WINDOW_NAMES)

    return map_batches(members.join(sequences, "doc_id").select("doc_id", "ats", "shingles"), cut, _WINDOW)


def repeated_passages(docs: DataFrame, rules: PassageRules | None = None) -> DataFrame:
    """``(doc_id, start, end, other_id, other_start, other_end, similarity)``: for
    each passage of a document that an earlier document (by doc_id) holds too, its
    words and those of its representative there; ends are exclusive.

    A group of documents with one passage gives one row for each but the first.
    Texts are lower-cased and cut at ASCII white space, whole. Rows with null
    doc_id or text, and texts shorter than a passage, give nothing; of rows that
    repeat one doc_id each text counts, and equal results come once. An empty table
    gives no rows; other columns are not read."""
    rules, keep = rules or PassageRules(), Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    columns = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
    met = keep.saved(_met(keep.saved(windows(docs, rules), "windows", merge=False), keep), "met")
    keep.drop(but=("met",))
    anchor = F.struct("key", "place")
    pairs = met.filter("doc_id != other_id").groupBy("doc_id", "other_id").agg(F.collect_list(anchor).alias("anchors"), F.bool_or("couple").alias("couple"), F.bit_or(F.expr("shiftleft(1, CAST(key & 7 AS INT))")).alias("functions"))
    pairs = keep.saved(pairs.withColumn("now", F.col("couple") | (F.bit_count("functions") >= rules.need)).drop("functions"), "pairs")
    ready = pairs.filter("now").select("doc_id", "other_id", "anchors", "couple")
    waiting = pairs.filter("not now").select(F.inline("anchors")).select("key")

    # A bit for each part of the pairs in which a document is one of them, or the representative.
    part = F.pmod(F.xxhash64("other_id"), F.lit(PARTS)).cast("int")
    bit, none = F.when(F.col("now"), F.expr("shiftleft(1, part)")).otherwise(0), F.lit(0)
    sides = pairs.select("doc_id", "other_id", "now", part.alias("part")).select("doc_id", "other_id", bit.alias("bit"))
    sides = sides.select("doc_id", F.col("bit").alias("mine"), none.alias("theirs")).union(sides.select("other_id", none, "bit"))
    ids = sides.groupBy("doc_id").agg(F.bit_or("mine").alias("mine"), F.bit_or("theirs").alias("theirs"))
    sequences = keep.saved(_sequences(docs, keep.saved(ids, "ids"), rules), "sequences", merge=False)
    told = None
    for k in range(PARTS):
        keep.forget()
        mine, theirs = (sequences.filter(F.col(side).bitwiseAND(1 << k) != 0) for side in ("mine", "theirs"))
        more = keep.saved(_verified(ready.filter(part == k), mine, theirs, rules), "told")
        told = more if told is None else told.union(more)
    keep.forget()
    # All members of groups with an unverified one, verified or not, meet again.
    failed = told.filter("start is null").select(F.explode("failed").alias("key")).union(waiting).distinct()
    failed = keep.saved(failed, "failed")
    keep.drop(but=("met", "sequences", "told", "failed"))
    members = met.filter("not couple").join(failed, "key", "left_semi").groupBy("doc_id").agg(F.collect_set(F.shiftright("place", 2 * _NEAR).cast("int")).alias("ats"))
    members = keep.saved(members, "members")
    keep.drop(but=("sequences", "told", "members"))
    rows = keep.saved(_again(members, sequences.select("doc_id", "shingles"), rules), "again", merge=False)
    keep.drop(but=("sequences", "told", "again"))
    again = keep.saved(_met(rows, keep), "met")
    keep.drop(but=("sequences", "told", "met"))
    more = again.filter("doc_id != other_id").groupBy("doc_id", "other_id").agg(F.collect_set(F.struct(F.lit(0).cast("long").alias("key"), "place")).alias("anchors"), F.lit(True).alias("couple"))
    more = keep.saved(more, "more")
    keep.drop(but=("sequences", "told", "more"))
    firsts = more.select(F.col("other_id").alias("doc_id")).distinct()
    more = keep.saved(_verified(more, sequences, sequences.join(firsts, "doc_id", "left_semi"), rules), "told")
    found = told.union(more).filter("start is not null").select(*columns).distinct()
    keep.drop(but=("told",))
    return found
