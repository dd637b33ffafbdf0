"""A run-length index of strings: suffix order, run-compressed Burrows-Wheeler
transform with sampled run ends, and matching statistics streamed through it.

Strings are kept as symbols (byte + 1) with a separator 0 after each. One suffix
order of all strings serves any collection of them: the order of the suffixes of
some of the strings is the order of all, filtered."""

from __future__ import annotations

import numpy as np

#: Symbols in one comparison word, of 9 bits each.
WORD = 7


class Strings:
    """Symbols, comparison words and the suffix order of distinct strings.

    A word holds the next seven symbols up to a separator. Suffixes that are equal
    up to their separators are ordered by place, so that ``x < y`` implies
    ``cx < cy``, as the transform needs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.first = offsets[:-1] + np.arange(len(sizes))
        self.size = sizes
        n = len(data) + len(sizes)
        self.symbols = np.zeros(n + 16 * WORD, np.uint16)
        at = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
        self.symbols[at] = data.astype(np.uint16) + 1
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        m = n + 15 * WORD
        self.words, alive = np.zeros(n + 16 * WORD, np.uint64), np.ones(m, bool)
        for k in range(WORD):
            symbol = self.symbols[k : m + k]
            alive &= symbol != 0
            self.words[:m] = (self.words[:m] << np.uint64(9)) | np.where(alive, symbol, 0).astype(np.uint64)
        self.order = self._sorted(n, ~alive[:n])

    def _sorted(self, n: int, ended: np.ndarray) -> np.ndarray:
        """Positions in suffix order, by doubling the compared length; only places
        that are still tied are sorted again."""
        order = np.argsort(self.words[:n], kind="stable")
        sorted_words = self.words[order]
        new = np.ones(n, bool)
        new[1:] = (sorted_words[1:] != sorted_words[:-1]) | ended[order[1:]]
        rank = np.empty(n + WORD, np.int64)
        begin = np.flatnonzero(new)
        rank[order] = np.repeat(begin, np.diff(np.r_[begin, n]))
        depth = WORD
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            rows = np.flatnonzero(tied)
            if not len(rows):
                return order
            places = order[rows]
            key = rank[places] * (n + 1) + rank[places + depth]
            by = np.argsort(key, kind="stable")
            order[rows], key = places[by], key[by]
            new[rows[1:]] |= key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            head = np.repeat(begin, np.diff(np.r_[begin, n]))
            rank[order[rows]] = head[rows]
            depth *= 2


class RunIndex:
    """Run-compressed transforms of several collections of strings, one after
    another: for each run its first row, symbol, collection, and the text places of
    its first and last row. Nothing else of the order is kept."""

    def __init__(self, strings: Strings, collection: np.ndarray, order: np.ndarray):
        """``collection``: of each string, from 0 without gaps; -1: not indexed.
        ``order``: the suffix order, at least of the strings indexed."""
        self.strings = strings
        of_row = collection[strings.owner[order]]
        rows = order[of_row >= 0]
        of_row = of_row[of_row >= 0]
        by = np.argsort(of_row, kind="stable")
        rows, of_row = rows[by], of_row[by]
        last = np.where(rows > 0, strings.symbols[rows - 1], 0)
        new = np.ones(len(rows), bool)
        new[1:] = (last[1:] != last[:-1]) | (of_row[1:] != of_row[:-1])
        self.start = np.flatnonzero(new)
        length = np.diff(np.r_[self.start, len(rows)])
        self.symbol, self.length = last[self.start], length
        self.first_place, self.last_place = rows[self.start], rows[self.start + length - 1]
        group = of_row[self.start] * 257 + self.symbol
        by = np.argsort(group, kind="stable")
        self.step = np.empty(len(by), np.int64)
        self.step[by] = np.cumsum(length[by]) - length[by]
        self.runs = len(by)
        self.key = group[by] * self.runs + by
        self.base = np.flatnonzero(np.r_[True, of_row[1:] != of_row[:-1]])

    def stream(self, queries: np.ndarray, collection: np.ndarray) -> np.ndarray:
        """Matching statistics of whole strings against their collections: for each
        text place of a query the place where a longest match that begins there is
        found (-1: its symbol does not occur); longest up to 8 words."""
        s = self.strings
        found = np.full(len(s.owner), -1, np.int64)
        queries = queries[np.argsort(-s.size[queries], kind="stable")]
        node, sizes = collection[queries], s.size[queries]
        at = s.first[queries] + sizes
        row = self.base[node]
        place = self.first_place[np.searchsorted(self.start, row, side="right") - 1]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            row, place, node, at = row[:live], place[:live], node[:live], at[:live] - 1
            symbol = s.symbols[at].astype(np.int64)
            run = np.searchsorted(self.start, row, side="right") - 1
            goes = self.symbol[run] == symbol
            turn = np.flatnonzero(~goes)
            offset = row - self.start[run]
            if len(turn):
                # The nearest runs of the symbol before and after; the one whose
                # sampled end shares more with what follows in the query is taken.
                want = node[turn] * 257 + symbol[turn]
                k = np.searchsorted(self.key, want * self.runs + run[turn])
                after, before = np.minimum(k, self.runs - 1), np.maximum(k - 1, 0)
                has_after, has_before = self.key[after] // self.runs == want, (self.key[before] // self.runs == want) & (k > 0)
                after, before = self.key[after] % self.runs, self.key[before] % self.runs
                both = np.flatnonzero(has_after & has_before)
                use_after = has_after.copy()
                use_after[both] = self._closer(at[turn[both]] + 1, self.first_place[after[both]], self.last_place[before[both]])
                chosen = np.where(use_after, after, before)
                lost = ~(has_after | has_before)
                run[turn], offset[turn] = chosen, np.where(use_after, 0, self.length[chosen] - 1)
                place[turn] = np.where(use_after, self.first_place[chosen], self.last_place[chosen])
            row, place = self.step[run] + offset, place - 1
            found[at] = place
            if len(turn) and lost.any():
                gone = turn[lost]
                found[at[gone]] = -1
                row[gone] = self.base[node[gone]]
                place[gone] = self.first_place[np.searchsorted(self.start, row[gone], side="right") - 1]
        return found

    def _closer(self, query: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text at ``a`` shares at least as much with ``query`` as at ``b``."""
        words = self.strings.words
        out = np.ones(len(query), bool)
        open_ = np.arange(len(query))
        for k in range(0, 8 * WORD, WORD):
            q = words[query[open_] + k]
            x, y = q ^ words[a[open_] + k], q ^ words[b[open_] + k]
            out[open_] = x <= y
            open_ = open_[(x == 0) & (y == 0)]
            if not len(open_):
                break
        return out


def long_matches(strings: Strings, found: np.ndarray, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, start)`` of each match of ``least`` symbols that the matching
    statistics lead to."""
    windows = np.maximum(strings.size[queries] - least + 1, 0)
    which = np.repeat(np.arange(len(queries)), windows)
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = strings.first[queries[which]] + start
    open_ = np.flatnonzero(found[at] >= 0)
    for k in [*range(0, least - WORD, WORD), least - WORD]:
        open_ = open_[strings.words[at[open_] + k] == strings.words[found[at[open_]] + k]]
    return queries[which[open_]], start[open_]


def repeats_of_earlier(strings: Strings, group: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(string, start)`` of each ``least`` symbols of a string that a string of its
    group with a smaller rank holds too. Ranks count from 0 in each group.

    Ranks are halved again and again: of each half pair the lower is indexed and the
    upper streamed through the index, so each two ranks of a group meet once."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    bits = int(rank.max()).bit_length() if len(rank) else 0
    most = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    np.maximum.at(most, group, rank)
    order = strings.order
    for b in range(bits):
        # Groups whose ranks all have fewer bits have met.
        order = order[(most[group] >> b > 0)[strings.owner[order]]]
        node = group * ((int(rank.max()) >> (b + 1)) + 1) + (rank >> (b + 1))
        upper = (rank >> b) & 1 == 1
        dense = np.intersect1d(node[upper], node[~upper])
        if not len(dense):
            continue
        k = np.minimum(np.searchsorted(dense, node), len(dense) - 1)
        in_play = dense[k] == node
        index = RunIndex(strings, np.where(in_play & ~upper, k, -1), order)
        queries = np.flatnonzero(in_play & upper)
        out.append(long_matches(strings, index.stream(queries, k), queries, least))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
