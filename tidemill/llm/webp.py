"""Lossless WebP in numpy: an encoder and a decoder for the VP8L bit stream.

Format (fixed by the public WebP lossless bit stream specification): a RIFF
container with one ``VP8L`` chunk; least significant bits first; up to four
transforms (predictor, cross-colour, subtract-green, colour indexing), an optional
colour cache, one or more groups of five prefix codes, and back-references.

Decoding a picture with one prefix-code group is vectorised: at every bit position
the token that would start there is looked up, then the chain of real tokens is
followed; back-references resolve by pointer doubling. Pictures with several groups
are walked token by token. Pixels are ARGB in uint32.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (dx, dy) of the distance codes 1 to 120.
NEAR_PIXELS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MAX_SIDE = 16384
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
_LITERALS, _LENGTHS, _DISTANCES = 256, 24, 40
_CACHE_MUL = 0x1E35A7BD
_DX = np.array([x for x, _ in NEAR_PIXELS])
_DY = np.array([y for _, y in NEAR_PIXELS])
_U = np.uint32


class WebPError(ValueError):
    """The bytes are no lossless WebP picture."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the symbols with counts, ``most`` bits at
    most (rare counts are raised until it fits)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), int(s), None) for s in used]
        heapq.heapify(heap)
        tie = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], tie, (a, b)))
            tie += 1
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, symbol, kids), depth = stack.pop()
            if kids is None:
                out[symbol] = depth
                deepest = max(deepest, depth)
            else:
                stack += [(kids[0], depth + 1), (kids[1], depth + 1)]
        if deepest <= most:
            return out
        floor = floor * 2 + 1


_MIRROR = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _MIRROR |= ((np.arange(1 << 15) >> _bit) & 1) << (14 - _bit)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes, ready for a stream of low bits first."""
    size = lengths.astype(np.int64)
    used = np.flatnonzero(size)
    order = used[np.lexsort((used, size[used]))]
    step = np.int64(1) << (15 - size[order])
    code = np.zeros(len(size), np.int64)
    code[order] = (np.cumsum(step) - step) >> (15 - size[order])
    return _MIRROR[code] >> (15 - size)


class Code:
    """A prefix code as lookup tables over the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else (0 if not len(used) else -1)
        if self.single >= 0:
            self.bits = 0
            self.symbol, self.size = np.array([self.single], np.int32), np.zeros(1, np.uint8)
            return
        size = lengths.astype(np.int64)
        if (np.int64(1) << (15 - size[used])).sum() != 1 << 15:
            raise WebPError("incomplete prefix code")
        self.bits = int(size.max())
        self.symbol, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.uint8)
        code = canonical(lengths)
        for s in used.tolist():
            self.symbol[code[s] :: 1 << size[s]] = s
            self.size[code[s] :: 1 << size[s]] = size[s]


# ---------------------------------------------------------------- bits


class Writer:
    """Collects (value, size) arrays; sizes are 32 bits at most."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, size: int) -> None:
        self.many([value], [size])

    def many(self, values: Iterable, sizes: Iterable) -> None:
        self.values.append(np.asarray(values, np.uint64))
        self.sizes.append(np.asarray(sizes, np.int64))

    def bytes(self) -> bytes:
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        keep = size > 0
        value, size = value[keep], size[keep]
        if not len(size):
            return b""
        end = np.cumsum(size)
        start = end - size
        moved = value << (start & 31).astype(np.uint64)
        word = start >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        low = np.add.reduceat(moved & np.uint64(0xFFFFFFFF), first)
        high = np.add.reduceat(moved >> np.uint64(32), first)
        out[word[first]] += low
        out[word[first] + 1] += high
        return out.astype("<u4").tobytes()[: int(end[-1] + 7) >> 3]


class Reader:
    """Bits of a stream; ``window(p)`` holds the 32 bits from position p on."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(16), np.uint8)
        self.words = raw[:-7].astype(np.uint64)
        for k in range(1, 5):
            self.words |= raw[k : k - 7].astype(np.uint64) << np.uint64(8 * k)
        self.end, self.at = 8 * len(data), 0

    def bits(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.end:
            raise WebPError("the stream ends early")
        out = (int(self.words[self.at >> 3]) >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, code: Code) -> int:
        if code.single >= 0:
            return code.single
        if self.at >= self.end:
            raise WebPError("the stream ends early")
        peek = (int(self.words[self.at >> 3]) >> (self.at & 7)) & ((1 << code.bits) - 1)
        self.at += int(code.size[peek])
        return int(code.symbol[peek])


# ---------------------------------------------------------------- writing


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits' number and value of lengths or distances from 1."""
    v = np.maximum(values.astype(np.int64) - 1, 0)
    top = np.zeros(len(v), np.int64)
    big = v >= 2
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    second = np.where(big, (v >> np.maximum(top - 1, 0)) & 1, 0)
    symbol = np.where(big, 2 * top + second, v)
    extra = np.where(symbol >= 4, (symbol - 2) >> 1, 0)
    return symbol, extra, v & ((np.int64(1) << extra) - 1)


def _run_lengths(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, extra value) of a list of code lengths."""
    out, i, n, before = [], 0, len(lengths), 8
    values = lengths.tolist()
    while i < n:
        j = i
        while j < n and values[j] == values[i]:
            j += 1
        run, v = j - i, values[i]
        if v == 0:
            while run >= 3:
                take = min(run, 138)
                out.append((17, 3, take - 3) if take <= 10 else (18, 7, take - 11))
                run -= take
        else:
            if v != before:
                out.append((v, 0, 0))
                before, run = v, run - 1
            while run >= 3:
                take = min(run, 6)
                out.append((16, 2, take - 3))
                run -= take
        out += [(v, 0, 0)] * run
        i = j
    return out


def _put_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the code for ``counts``; its codes and sizes (0 for a lone symbol)."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.many([1, 0, int(s > 1), s], [1, 1, 1, 8 if s > 1 else 1])
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts, 15)
    runs = _run_lengths(lengths)
    meta = code_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
    listed = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if meta[s]))
    w.many([0, listed - 4, *(int(meta[s]) for s in CODE_LENGTH_ORDER[:listed]), 0], [1, 4, *[3] * listed, 1])
    codes, sizes = canonical(meta), meta.astype(np.int64)
    if (meta > 0).sum() == 1:
        sizes = np.zeros_like(sizes)
    values, bits = [], []
    for s, extra, value in runs:
        values += [int(codes[s]), value]
        bits += [int(sizes[s]), extra]
    w.many(values, bits)
    if len(used) == 1:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return canonical(lengths), lengths.astype(np.int64)


def _runs(pixels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches that repeat the pixel before them."""
    same = np.r_[False, pixels[1:] == pixels[:-1], False]
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    if not len(edge):
        return edge, edge
    start, size = edge[::2], edge[1::2] - edge[::2]
    keep = size >= least
    return start[keep], size[keep]


def _cached(pixels: np.ndarray, bits: int) -> np.ndarray:
    """Which pixels the colour cache holds when they come."""
    slot = ((pixels * _U(_CACHE_MUL)) >> _U(32 - bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    a, b = order[1:], order[:-1]
    hit[a] = (slot[a] == slot[b]) & (pixels[a] == pixels[b])
    first = np.r_[True, slot[order][1:] != slot[order][:-1]] if len(order) else np.zeros(0, bool)
    hit[order[first]] = pixels[order[first]] == 0
    return hit


def _put_pixels(w: Writer, pixels: np.ndarray, width: int, cache_bits: int = 0, top: bool = True, least_run: int = 5) -> None:
    """An entropy-coded picture with one code group: literals, cache hits, and
    back-references to the pixel on the left."""
    w.many([int(cache_bits > 0), cache_bits], [1, 4 if cache_bits else 0])
    if top:
        w.put(0, 1)  # no meta prefix codes
    n = len(pixels)
    start, size = _runs(pixels, least_run)
    covered = np.zeros(n + 1, np.int64)
    covered[start] += 1
    covered[start + size] -= 1
    inside = np.cumsum(covered[:n]) > 0
    begin = np.zeros(n, bool)
    begin[start] = True
    emit = ~inside | begin
    at = np.flatnonzero(emit)
    run = begin[at]
    if len(size) and size.max() > 4096:  # cut long stretches
        pieces = [(s + k, min(4096, z - k)) for s, z in zip(start.tolist(), size.tolist()) for k in range(0, z, 4096)]
        start, size = np.array([p for p, _ in pieces]), np.array([z for _, z in pieces])
        begin[start] = True
        at = np.flatnonzero(~inside | begin)
        run = begin[at]
    argb = pixels[at]
    green = ((argb >> _U(8)) & _U(255)).astype(np.int64)
    symbol = green.copy()
    literal = ~run
    if cache_bits:
        hit = _cached(pixels, cache_bits)[at] & ~run
        slot = ((argb * _U(_CACHE_MUL)) >> _U(32 - cache_bits)).astype(np.int64)
        symbol[hit] = _LITERALS + _LENGTHS + slot[hit]
        literal &= ~hit
    code, extra, rest = _prefix(size)
    symbol[run] = _LITERALS + code
    parts = [symbol, ((argb >> _U(16)) & _U(255)).astype(np.int64), (argb & _U(255)).astype(np.int64), (argb >> _U(24)).astype(np.int64)]
    alphabet = (_LITERALS + _LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256)
    codes = []
    for k in range(4):
        codes.append(_put_code(w, np.bincount(parts[k] if k == 0 else parts[k][literal], minlength=alphabet[k])))
    # the pixel on the left is distance code 2 (dx 1, dy 0): symbol 1, no extra bits
    _put_code(w, np.bincount([1], minlength=_DISTANCES) * len(size))
    columns = [(codes[0][0][symbol], codes[0][1][symbol])]
    for k in (1, 2, 3):
        value, bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if codes[k][1].any():
            value[literal], bits[literal] = codes[k][0][parts[k][literal]], codes[k][1][parts[k][literal]]
        if k == 1 and len(size):
            value[run], bits[run] = rest, extra
        if bits.any():
            columns.append((value, bits))
    w.many(np.stack([c[0] for c in columns], axis=1).ravel(), np.stack([c[1] for c in columns], axis=1).ravel())


def _tiles(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, tile_bits: int = 4, mode: int = 11) -> bytes:
    """A WebP file of ``pixels`` (height x width, uint32 ARGB).

    ``transforms`` apply in the given order; predictor and cross-colour use one
    setting for all tiles (``mode``; fixed multipliers)."""
    height, width = pixels.shape
    if not 0 < height <= MAX_SIDE or not 0 < width <= MAX_SIDE:
        raise WebPError("a side must be from 1 to 16384")
    w = Writer()
    w.many([0x2F, width - 1, height - 1, int(bool((pixels >> _U(24) != 255).any())), 0], [8, 14, 14, 1, 3])
    now = pixels
    for kind in transforms:
        w.many([1, kind], [1, 2])
        if kind in (PREDICTOR, CROSS):
            w.put(tile_bits - 2, 3)
            tiles = _tiles(now.shape[0], tile_bits) * _tiles(now.shape[1], tile_bits)
            setting = 0xFF000000 | (mode << 8 if kind == PREDICTOR else 3 << 16 | 250 << 8 | 17)
            _put_pixels(w, np.full(tiles, setting, _U), _tiles(now.shape[1], tile_bits), top=False)
            now = _residual(now, mode) if kind == PREDICTOR else _cross(now, 17, 250, 3, -1)
        elif kind == GREEN:
            now = _green(now, -1)
        else:
            colours, index = np.unique(now, return_inverse=True)
            if len(colours) > 256:
                raise WebPError("more than 256 colours")
            w.put(len(colours) - 1, 8)
            _put_pixels(w, np.r_[colours[:1], _sub(colours[1:], colours[:-1])], len(colours), top=False)
            now = _bundle(index.reshape(now.shape), len(colours))
    w.put(0, 1)
    _put_pixels(w, now.ravel(), now.shape[1], cache_bits)
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ---------------------------------------------------------------- transforms


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of each channel, modulo 256."""
    return ((a & _U(0xFF00FF00)) + (b & _U(0xFF00FF00)) & _U(0xFF00FF00)) | ((a & _U(0x00FF00FF)) + (b & _U(0x00FF00FF)) & _U(0x00FF00FF))


def _sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a | _U(0x00FF00FF)) - (b & _U(0xFF00FF00))) & _U(0xFF00FF00)) | (((a | _U(0xFF00FF00)) - (b & _U(0x00FF00FF))) & _U(0x00FF00FF))


def _green(p: np.ndarray, sign: int) -> np.ndarray:
    g = (p >> _U(8)) & _U(255)
    both = g << _U(16) | g
    return _add(p, both) if sign > 0 else _sub(p, both)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).astype(np.uint8).astype(np.int8).astype(np.int64)


def _cross(p: np.ndarray, green_red, green_blue, red_blue, sign: int) -> np.ndarray:
    """Cross-colour with 3.5 fixed-point multipliers; sign -1 encodes."""
    green, red, blue = _signed(p >> _U(8)), (p >> _U(16)).astype(np.int64) & 255, p.astype(np.int64) & 255
    new_red = (red + sign * ((_signed(np.asarray(green_red)) * green) >> 5)) & 255
    seen = _signed(new_red if sign > 0 else red)
    new_blue = (blue + sign * ((_signed(np.asarray(green_blue)) * green) >> 5) + sign * ((_signed(np.asarray(red_blue)) * seen) >> 5)) & 255
    return (p & _U(0xFF00FF00)) | (new_red << 16).astype(_U) | new_blue.astype(_U)


def _bundle(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indexes in the green channel, several to a pixel if they are small."""
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    height, width = index.shape
    per, size = 1 << bits, 8 >> bits
    wide = np.zeros((height, _tiles(width, bits) * per), _U)
    wide[:, :width] = index
    parts = wide.reshape(height, -1, per)
    out = np.zeros(parts.shape[:2], _U)
    for k in range(per):
        out |= parts[:, :, k] << _U(k * size)
    return _U(0xFF000000) | out << _U(8)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & _U(0xFEFEFEFE)) >> _U(1)) + (a & b)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([(p >> _U(s)).astype(np.int64) & 255 for s in (24, 16, 8, 0)])


def _argb(c: np.ndarray) -> np.ndarray:
    c = np.clip(c, 0, 255).astype(_U)
    return c[0] << _U(24) | c[1] << _U(16) | c[2] << _U(8) | c[3]


def _predict(mode: int, left, top, right, corner):
    """The prediction of one mode from its four neighbours (arrays of uint32)."""
    if mode == 0 or mode > 13:
        return np.full_like(top, 0xFF000000)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 10:
        pair = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
        return _average(*pair[mode]) if mode < 10 else _average(_average(left, corner), _average(top, right))
    l, t, c = _channels(left), _channels(top), _channels(corner)
    if mode == 11:
        guess = l + t - c
        return np.where(np.abs(guess - l).sum(0) < np.abs(guess - t).sum(0), left, top)
    if mode == 12:
        return _argb(l + t - c)
    mean = _channels(_average(left, top))
    half = mean - c
    return _argb(mean + np.trunc(half / 2).astype(np.int64))


def _residual(p: np.ndarray, mode: int) -> np.ndarray:
    """Prediction residuals with one mode everywhere."""
    height, width = p.shape
    guess = np.empty_like(p)
    left = np.empty_like(p)
    left[:, 1:], left[:, 0] = p[:, :-1], 0
    if height > 1:
        top, corner = p[:-1], np.empty_like(p[:-1])
        corner[:, 1:], corner[:, 0] = top[:, :-1], 0
        right = np.empty_like(top)
        right[:, :-1], right[:, -1] = top[:, 1:], p[1:, 0]
        guess[1:] = _predict(mode, left[1:], top, right, corner)
        guess[1:, 0] = p[:-1, 0]
    guess[0, 1:] = p[0, :-1]
    guess[0, 0] = 0xFF000000
    return _sub(p, guess)


def _running(p: np.ndarray) -> np.ndarray:
    """Running sums of each channel, modulo 256."""
    return np.bitwise_or.reduce([((np.cumsum((p >> _U(s)).astype(np.int64) & 255) & 255) << s).astype(_U) for s in (0, 8, 16, 24)])


def _unpredict(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Rows with modes that look only at the row above are summed at once; the
    others go pixel by pixel."""
    height, width = residual.shape
    out = residual.copy()
    out[:1, :1] = _add(out[:1, :1], _U(0xFF000000))
    out[0] = _running(out[0])
    out[:, 0] = _running(out[:, 0])
    for y in range(1, height):
        row = modes[y >> bits][np.arange(width) >> bits]
        right = np.r_[out[y - 1, 1:], out[y, 0]]
        corner = np.r_[_U(0), out[y - 1, :-1]]
        free = np.isin(row, (0, 2, 3, 4, 8, 9, 14, 15))
        free[0] = False
        for mode in np.unique(row[free]):
            m = free & (row == mode)
            out[y, m] = _add(out[y, m], _predict(int(mode), out[y - 1, m], out[y - 1, m], right[m], corner[m]))
        for x in np.flatnonzero(~free)[1:].tolist():
            one = slice(x, x + 1)
            out[y, one] = _add(out[y, one], _predict(int(row[x]), out[y, x - 1 : x], out[y - 1, one], right[one], corner[one]))
    return out


# ---------------------------------------------------------------- reading


def _read_code(r: Reader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.uint8)
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        found = [r.bits(8 if wide else 1)] + ([r.bits(8)] if two else [])
        if max(found) >= alphabet:
            raise WebPError("symbol out of range")
        lengths[found] = 1
        return Code(lengths)
    meta = np.zeros(19, np.uint8)
    for k in range(4 + r.bits(4)):
        meta[CODE_LENGTH_ORDER[k]] = r.bits(3)
    code = Code(meta)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    i, before = 0, 8
    while i < alphabet and left > 0:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
            continue
        n = 3 + r.bits(2) if s == 16 else 3 + r.bits(3) if s == 17 else 11 + r.bits(7)
        if i + n > alphabet:
            raise WebPError("code lengths out of range")
        lengths[i : i + n] = before if s == 16 else 0
        i += n
    return Code(lengths)


def _distance(code: np.ndarray, width: int) -> np.ndarray:
    """Distances in pixels from distance codes (from 1)."""
    near = np.minimum(code, 120) - 1
    return np.where(code > 120, code - 120, np.maximum(_DX[near] + _DY[near] * width, 1))


def _tokens(r: Reader, codes: list[Code], n: int) -> tuple[np.ndarray, ...]:
    """Green symbol, packed red/blue/alpha or length, and distance code of each
    token until n pixels are covered; one code group for all."""
    base = r.at
    m = r.end - base
    # The 32 bits from each position on, for eight positions of a byte at once.
    window = (r.words[base >> 3 : (r.end >> 3) + 1, None] >> np.arange(8, dtype=np.uint64)).astype(np.uint32).ravel()[base & 7 :][: m + 1]

    def look(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if code.single >= 0:
            return np.full(len(at), code.single, np.int32), at
        peek = (window if at is every else window[np.minimum(at, m)]) & _U((1 << code.bits) - 1)
        return code.symbol[peek], at + code.size[peek]

    def extra(symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.where(symbol >= 4, (symbol - 2) >> 1, 0)
        rest = window[np.minimum(at, m)].astype(np.int64) & ((np.int64(1) << size) - 1)
        value = np.where(symbol >= 4, ((2 + (symbol & 1)).astype(np.int64) << size) + rest, symbol) + 1
        return value, at + size

    every = at = np.arange(m + 1, dtype=np.int32)
    green, after = look(codes[0], at)
    following = after.copy()
    if any(c.single < 0 for c in codes[1:4]):
        lit = np.flatnonzero(green < _LITERALS)
        to = after[lit]
        for code in codes[1:4]:
            _, to = look(code, to)
        following[lit] = to
    back = np.flatnonzero((green >= _LITERALS) & (green < _LITERALS + _LENGTHS))
    if len(back):
        _, to = extra(green[back] - _LITERALS, after[back])
        symbol, to = look(codes[4], to)
        _, to = extra(symbol, to)
        following[back] = to
    if (following[:-1] == at[:-1]).any() and codes[0].single >= 0 and codes[0].single < _LITERALS and all(c.single >= 0 for c in codes[1:4]):
        path = np.zeros(n, np.int64)  # a picture of one colour takes no bits
    else:
        # Four tokens at a time: the chain is walked over every fourth one.
        one = np.minimum(following, m)
        two = one[one]
        step = memoryview(two[two])
        spans = None
        if len(back):
            spans = np.ones(m + 1, np.int32)
            spans[back] = extra(green[back] - _LITERALS, after[back])[0]
        parts, p, left = [], 0, n
        while left > 0:  # a token covers a pixel at least
            part = []
            append = part.append
            for _ in range((min(left, 4096) if spans is not None else left) + 3 >> 2):
                append(p)
                p = step[p]
            first = np.array(part, np.int32)
            third = two[first]
            part = np.stack([first, one[first], third, one[third]], axis=1).ravel()
            covered = np.cumsum(spans[part]) if spans is not None else np.arange(1, len(part) + 1)
            used = int(np.searchsorted(covered, left)) + 1
            part, covered = part[:used], covered[:used]
            left -= int(covered[-1])
            parts.append(part)
        path = np.concatenate(parts) if len(parts) > 1 else parts[0]
        ends = following[path]
        if path[-1] >= m or ends[-1] > m:
            raise WebPError("the stream ends early")
        r.at = base + int(ends[-1])
    g = green[path]
    value, dist = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)
    lit = g < _LITERALS
    to, packed = None, 0
    for shift, code in zip((16, 0, 24), codes[1:4]):
        if code.single >= 0:
            packed = packed | code.single << shift
        else:
            s, to = look(code, after[path[lit]] if to is None else to)
            packed = packed | s.astype(np.int64) << shift
    value[lit] = packed
    ref = (g >= _LITERALS) & (g < _LITERALS + _LENGTHS)
    if ref.any():
        value[ref], to = extra(g[ref] - _LITERALS, after[path[ref]])
        symbol, to = look(codes[4], to)
        dist[ref], _ = extra(symbol, to)
    return g, value, dist


def _walk(r: Reader, groups: list[list[Code]], meta: np.ndarray, bits: int, n: int, width: int) -> tuple[np.ndarray, ...]:
    """Tokens like ``_tokens``, one by one, for several code groups."""
    out: list[tuple[int, int, int]] = []
    at = 0

    def number(symbol: int) -> int:
        if symbol < 4:
            return symbol + 1
        size = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << size) + r.bits(size) + 1

    while at < n:
        codes = groups[int(meta[(at // width) >> bits, (at % width) >> bits])]
        g = r.symbol(codes[0])
        if g < _LITERALS:
            red, blue, alpha = (r.symbol(c) for c in codes[1:4])
            out.append((g, red << 16 | blue | alpha << 24, 0))
            at += 1
        elif g < _LITERALS + _LENGTHS:
            size = number(g - _LITERALS)
            out.append((g, size, number(r.symbol(codes[4]))))
            at += size
        else:
            out.append((g, 0, 0))
            at += 1
    columns = np.array(out, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def _assemble(g: np.ndarray, value: np.ndarray, code: np.ndarray, n: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels from tokens."""
    lit, ref = g < _LITERALS, (g >= _LITERALS) & (g < _LITERALS + _LENGTHS)
    size = np.where(ref, value, 1)
    start = np.cumsum(size) - size
    if len(size) and int(start[-1] + size[-1]) > n:
        raise WebPError("a back-reference runs over the end")
    far = _distance(code[ref], width)
    if (far > start[ref]).any():
        raise WebPError("a back-reference starts before the picture")
    out = np.zeros(n, _U)
    out[start[lit]] = (value[lit] | g[lit].astype(np.int64) << 8).astype(_U)
    if cache_bits and (~lit & ~ref).any():
        cache, done = [0] * (1 << cache_bits), 0
        pixels = out.tolist()
        distance = np.zeros(len(g), np.int64)
        distance[ref] = far
        for s, a, z, d in zip(g.tolist(), start.tolist(), size.tolist(), distance.tolist()):
            if s >= _LITERALS + _LENGTHS:
                pixels[a] = cache[s - _LITERALS - _LENGTHS]
            elif s >= _LITERALS:
                for k in range(a, a + z):
                    pixels[k] = pixels[k - d]
            for k in range(a, a + z):
                cache[(pixels[k] * _CACHE_MUL & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        return np.array(pixels, _U)
    if ref.any():
        source = np.arange(n)
        run = size[ref]
        cells = np.repeat(start[ref], run) + (np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run))
        source[cells] = cells - np.repeat(far, run)
        while True:
            following = source[source]
            if (following == source).all():
                break
            source = following
        out = out[source]
    return out


def _read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache too large")
    groups, meta, bits = 1, None, 0
    if top and r.bits(1):
        bits = r.bits(3) + 2
        picture = _read_pixels(r, _tiles(width, bits), _tiles(height, bits), False)
        meta = ((picture >> _U(8)) & _U(0xFFFF)).astype(np.int64)
        groups = int(meta.max()) + 1
    alphabet = (_LITERALS + _LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, _DISTANCES)
    codes = [[_read_code(r, a) for a in alphabet] for _ in range(groups)]
    n = width * height
    tokens = _tokens(r, codes[0], n) if groups == 1 else _walk(r, codes, meta, bits, n, width)
    return _assemble(*tokens, n, width, cache_bits).reshape(height, width)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, uint32 ARGB) of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("no lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if size > len(data) - 20:
        raise WebPError("the chunk is cut off")
    r = Reader(data[20 : 20 + size])
    if r.bits(8) != 0x2F:
        raise WebPError("wrong signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise WebPError("unknown version")
    undo: list[tuple] = []
    now = width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.bits(3) + 2
            undo.append((kind, now, bits, _read_pixels(r, _tiles(now, bits), _tiles(height, bits), False)))
        elif kind == GREEN:
            undo.append((kind, now))
        else:
            n = r.bits(8) + 1
            colours = _read_pixels(r, n, 1, False)[0]
            colours = _running(colours)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, bits, colours))
            now = _tiles(now, bits)
    p = _read_pixels(r, now, height, True)
    for kind, wide, *rest in reversed(undo):
        if kind == GREEN:
            p = _green(p, 1)
        elif kind == PALETTE:
            bits, colours = rest
            per, size = 1 << bits, 8 >> bits
            index = (p >> _U(8)) & _U(255)
            index = np.stack([(index >> _U(k * size)) & _U((1 << size) - 1) for k in range(per)], axis=2).reshape(height, -1)[:, :wide]
            table = np.zeros(256, _U)
            table[: len(colours)] = colours
            p = table[index]
        else:
            bits, setting = rest
            if kind == PREDICTOR:
                p = _unpredict(p, ((setting >> _U(8)) & _U(255)).astype(np.int64), bits)
            else:
                each = setting[np.arange(height)[:, None] >> bits, np.arange(wide)[None, :] >> bits]
                p = _cross(p, each & _U(255), (each >> _U(8)) & _U(255), (each >> _U(16)) & _U(255), 1)
    return p
