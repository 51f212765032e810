"""Lossless WebP's bit stream (RFC 9649): transforms, backward references, codes."""

from __future__ import annotations

import numpy as np

from . import bits
from .predictors import subtract_green, tile_modes
from .prefix_codes import VP8L_ORDER, canonical, header_codes, limited_lengths, run_lengths

CACHE_BITS = 10
SHORTEST, LONGEST, WINDOW = 3, 4096, 1 << 18
GREEN, DISTANCES = 256 + 24, 40

# The (x, y) offsets of the 120 short distance codes (RFC 9649, 5.2.2).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


def near_codes(width: int) -> dict[int, int]:
    """The least short code of each distance in pixels, for an image width."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        if x + y * width >= 1:
            out.setdefault(x + y * width, code)
    return out


def prefix_split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra value of lengths or distance codes from 1."""
    v = np.asarray(v, np.int64) - 1
    high = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 0)
    n = np.maximum(high - 1, 0)
    return np.where(v < 4, v, 2 * high + (v >> n & 1)), np.where(v < 4, 0, n), np.where(v < 4, 0, v & ((1 << n) - 1))


def cache_slot(argb: np.ndarray) -> np.ndarray:
    """The colour cache slot of packed pixels (a product modulo 2**32)."""
    return (argb.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)


def cache_before(argb: np.ndarray, at: int) -> np.ndarray:
    """The colour cache after the pixels before ``at``: the last pixel of each slot."""
    out = np.zeros(1 << CACHE_BITS, np.uint32)
    out[cache_slot(argb[:at]).astype(np.int64)] = argb[:at]
    return out


def packed(argb: np.ndarray) -> np.ndarray:
    """Channels last to one word a pixel."""
    x = argb.reshape(-1, 4).astype(np.uint32)
    return x[:, 0] << np.uint32(24) | x[:, 1] << np.uint32(16) | x[:, 2] << np.uint32(8) | x[:, 3]


LITERAL, CACHED, COPY = range(3)


class _Repeats:
    """How far a sequence goes on alike from two places: ranks of all stretches of 1, 2, 4, ... values.

    Two stretches are equal if their ranks are, and a stretch of 2k is ranked by
    its halves; stretches that leave the sequence are equal to none.
    """

    def __init__(self, x: np.ndarray, most: int):
        self.n, self.ranks = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while 2 * size <= min(most, self.n):
            half = self.ranks[-1]
            inside = half[:self.n - 2 * size + 1] * (self.n + 1) + half[size:self.n - size + 1]
            found, rank = np.unique(inside, return_inverse=True)
            if len(found) == len(rank):  # no stretch this long occurs again
                break
            self.ranks.append(np.concatenate([rank, len(found) + np.arange(2 * size - 1)]))
            size *= 2

    def before(self, level: int) -> np.ndarray:
        """For each place the last one before it with an equal stretch of 2 ** level values, or -1."""
        rank = self.ranks[level]
        order = np.argsort(rank, kind="stable")
        out = np.full(self.n, -1, np.int64)
        same = rank[order][1:] == rank[order][:-1]
        out[order[1:][same]] = order[:-1][same]
        return out

    def alike(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many values are alike from the places ``at`` and, before them, ``other``."""
        length = np.zeros(len(at), np.int64)
        for level in [len(self.ranks) - 1, *range(len(self.ranks) - 1, -1, -1)]:
            inside = np.flatnonzero(at + length < self.n)
            while len(inside):
                i, j = at[inside] + length[inside], other[inside] + length[inside]
                inside = inside[self.ranks[level][i] == self.ranks[level][j]]
                length[inside] += 1 << level
                # stretches of the longest size ranked may follow one another
                inside = inside[at[inside] + length[inside] < self.n] if level == len(self.ranks) - 1 else inside[:0]
        return length


def references(argb: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    """Tokens ``(kind, value, distance code)``, one a row, of the pixels from start to stop.

    For every pixel at once the longest copy is looked up among the pixel before,
    the one above, and the nearest places where the next 2, 4, 16 and 64 pixels are
    the same; it may reach back into pixels before ``start`` and ends with the band.
    Going through the pixels, a copy waits if one that is longer begins at the next.
    """
    near = near_codes(width)
    floor = max(0, start - WINDOW)
    x = argb[floor:stop]
    first, n = start - floor, stop - start
    if n <= 0:
        return np.zeros((0, 3), np.int64)
    own = np.arange(first, len(x))
    repeats = _Repeats(x, LONGEST)
    sources = [own - 1, own - width]
    sources += [repeats.before(level)[first:] for level in (1, 2, 4, 6) if level < len(repeats.ranks)]
    length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for source in sources:
        there = np.flatnonzero((source >= 0) & (own - source <= WINDOW))
        found = np.minimum(repeats.alike(own[there], source[there]), LONGEST)
        better = found > length[there]
        length[there[better]], distance[there[better]] = found[better], (own - source)[there[better]]
    # the cache holds each slot's last pixel whatever tokens are chosen
    slot = cache_slot(argb[:stop]).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    last = np.full(stop, -1, np.int64)
    same = slot[order][1:] == slot[order][:-1]
    last[order[1:][same]] = order[:-1][same]
    last = last[start:]
    held = np.where(last >= 0, argb[last], 0) == argb[start:stop]  # an empty slot holds 0
    waits = np.append(length[1:] > length[:-1], False)
    copies = ((length >= SHORTEST) & ~waits).tolist()
    steps = length.tolist()
    at, begins = 0, []
    while at < n:
        begins.append(at)
        at += steps[at] if copies[at] else 1
    at = np.array(begins, np.int64)
    copied = np.array(copies, bool)[at]
    kind = np.where(copied, COPY, np.where(held[at], CACHED, LITERAL))
    value = np.where(copied, length[at], np.where(held[at], slot[start:][at], argb[start:stop][at].astype(np.int64)))
    code = np.where(copied, distance[at] + len(NEAR), 0)
    for d in np.unique(distance[at][copied]).tolist():
        if d in near:
            code[copied & (distance[at] == d)] = near[d]
    return np.stack([kind, value, code], axis=1)


def resolve(tokens, before: np.ndarray, width: int) -> np.ndarray:
    """The pixels that tokens stand for, after those in ``before`` (a check)."""
    by_code = {code: x + y * width for code, (x, y) in enumerate(NEAR, 1)}
    cache = cache_before(before, len(before)).tolist()
    out = before.tolist()

    def put(p: int) -> None:
        out.append(p)
        cache[int(cache_slot(np.array([p], np.uint32))[0])] = p

    for kind, value, code in np.asarray(tokens).tolist():
        if kind == COPY:
            d = max(1, by_code[code]) if code <= len(NEAR) else code - len(NEAR)
            for _ in range(value):
                put(out[-d])
        else:
            put(cache[value] if kind == CACHED else value)
    return np.array(out[len(before):], np.uint32)


def symbols(tokens, cached: bool = True) -> list[np.ndarray]:
    """Fields ``(alphabet, symbol, extra value, extra bits)`` of tokens, in stream order."""
    t = np.array(tokens, np.int64).reshape(-1, 3)
    kind, value, code = t.T
    n = len(t)
    ls, ln, lx = prefix_split(np.maximum(value * (kind == COPY), 1))
    ds, dn, dx = prefix_split(np.maximum(code, 1))
    lit, copy, zero = kind == LITERAL, kind == COPY, np.zeros(n, np.int64)
    green = np.where(lit, value >> 8 & 255, np.where(copy, 256 + ls, 256 + 24 + value))
    columns = [
        (zero, green, np.where(copy, lx, 0), np.where(copy, ln, 0), np.ones(n, bool)),
        (zero + 1, value >> 16 & 255, zero, zero, lit),
        (zero + 2, value & 255, zero, zero, lit),
        (zero + 3, value >> 24 & 255, zero, zero, lit),
        (zero + 4, ds, dx, dn, copy),
    ]
    keep = np.stack([c[4] for c in columns], axis=1).ravel()
    return [np.stack([c[i] for c in columns], axis=1).ravel()[keep] for i in range(4)]


def alphabet_sizes(cache: bool) -> tuple[int, ...]:
    return GREEN + (1 << CACHE_BITS if cache else 0), 256, 256, 256, DISTANCES


def code_lengths(fields: list[list[np.ndarray]], cache: bool) -> list[np.ndarray]:
    """Lengths of the five codes, from the symbols of all bands together."""
    out = []
    for k, size in enumerate(alphabet_sizes(cache)):
        counts = sum((np.bincount(f[1][f[0] == k], minlength=size) for f in fields), np.zeros(size, np.int64))
        out.append(limited_lengths(counts, 15))
    return out


def code_header(lengths: np.ndarray) -> list[tuple[int, int]]:
    """How a code is sent: its one or two symbols, or its lengths."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and all(s < 256 for s in used):
        if not len(used):
            used = np.array([0])
        first = int(used[0])
        out = [(1, 1), (len(used) - 1, 1), (0, 1) if first < 2 else (1, 1), (first, 1 if first < 2 else 8)]
        return out + [(int(s), 8) for s in used[1:]]
    runs = run_lengths(lengths, repeat_first=8)
    own, codes = header_codes(runs)
    n = max(4, max(k for k, s in enumerate(VP8L_ORDER) if own[s]) + 1)
    out = [(0, 1), (n - 4, 4), *((int(own[s]), 3) for s in VP8L_ORDER[:n]), (0, 1)]
    lone = np.count_nonzero(own) == 1
    for s, extra, width in runs:
        out += [(int(codes[s]), 0 if lone else int(own[s])), (extra, width)]
    return out


def band_stream(fields: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[bytes, int]:
    """The symbols of one band as ``(bytes, bits)``."""
    alphabet, symbol, extra, width = fields
    value, size = np.zeros((len(symbol), 2), np.int64), np.zeros((len(symbol), 2), np.int64)
    for k, own in enumerate(lengths):
        here = alphabet == k
        lone = np.count_nonzero(own) <= 1
        value[here, 0], size[here, 0] = canonical(own)[symbol[here]], 0 if lone else own[symbol[here]]
    value[:, 1], size[:, 1] = extra, width
    stream = bits.code_bits(value.ravel(), size.ravel())
    return bits.pack(stream), len(stream)


def _fields(pairs: list[tuple[int, int]]) -> tuple[bytes, int]:
    v, n = zip(*pairs)
    stream = bits.code_bits(np.array(v, np.int64), np.array(n, np.int64))
    return bits.pack(stream), len(stream)


def encode(argb: np.ndarray, bands: list[int] | None = None) -> bytes:
    """The VP8L stream of an image ``(h, w, 4)`` in alpha, red, green, blue.

    ``bands`` are the first rows of bands and the height; each band's references
    and symbols are made apart and spliced.
    """
    h, w, _ = argb.shape
    bands = bands or [0, h]
    alpha = bool((argb[..., 0] != 255).any())
    modes, _, residual = tile_modes(subtract_green(argb))
    parts = [_fields([(0x2F, 8), (w - 1, 14), (h - 1, 14), (int(alpha), 1), (0, 3), (1, 1), (2, 2), (1, 1), (0, 2), (2, 3)])]
    # the modes are an image of their own: opaque, the mode in green
    sub = symbols([(LITERAL, 0xFF000000 | int(m) << 8, 0) for m in modes.ravel()])
    lengths = code_lengths([sub], cache=False)
    parts += [_fields([(0, 1)]), *(_fields(code_header(x)) for x in lengths), band_stream(sub, lengths)]
    flat = packed(residual)
    fields = [symbols(references(flat, a * w, b * w, w)) for a, b in zip(bands, bands[1:])]
    lengths = code_lengths(fields, cache=True)
    parts += [_fields([(0, 1), (1, 1), (CACHE_BITS, 4), (0, 1)]), *(_fields(code_header(x)) for x in lengths)]
    parts += [band_stream(f, lengths) for f in fields]
    return bits.splice(parts)[0]
