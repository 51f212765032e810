"""Deflate in bands: pluggable compressors, band joining, and a fast fixed-distance mode."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np

from . import bits
from .prefix_codes import DEFLATE_ORDER, canonical, header_codes, limited_lengths, run_lengths

WINDOW = 32 << 10
SMALL_BLOCK = 4096
BLOCK_TOKENS = 1 << 16
LONGEST = 258


class Compressor(Protocol):
    """What a band compressor offers: raw deflate, an empty stored block after ``flush``."""

    def compress(self, data: bytes) -> bytes: ...

    def flush(self, mode: int = ...) -> bytes: ...


Factory = Callable[[int, bytes], Compressor]


def zlib_factory(level: int, dictionary: bytes) -> Compressor:
    """The standard library's compressor, primed with the bytes before the band."""
    if dictionary:
        return zlib.compressobj(level, zlib.DEFLATED, -15, 8, zlib.Z_DEFAULT_STRATEGY, dictionary)
    return zlib.compressobj(level, zlib.DEFLATED, -15)


COMPRESSORS: dict[str, Factory] = {"zlib": zlib_factory}


def register(name: str, factory: Factory) -> None:
    """Make a compressor known by name; executors need it importable too."""
    COMPRESSORS[name] = factory


def deflate_band(data: bytes, before: bytes, last: bool, level: int = 6, factory: Factory = zlib_factory) -> bytes:
    """One band as raw deflate that refers back into ``before`` and ends at a byte border."""
    c = factory(level, before[-WINDOW:])
    return c.compress(data) + c.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def zlib_header(level: int) -> bytes:
    """CMF and FLG for a 32 KiB window; the check makes the pair a multiple of 31."""
    kind = 0 if level in (0, 1) else 1 if 2 <= level <= 5 else 2 if level in (6, -1) else 3
    head = 0x78 << 8 | kind << 6
    return struct.pack(">H", head + 31 - head % 31)


def adler_combine(first: int, second: int, second_length: int) -> int:
    """Adler-32 of two stretches joined, from the sums of each."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (b1 + b2 + second_length % base * (a1 - 1)) % base << 16 | (a1 + a2 - 1) % base


def join_bands(bands: list[tuple[bytes, int, int]], level: int = 6) -> bytes:
    """A zlib stream of bands ``(deflated, adler, length)`` in order."""
    total = 1
    for _, adler, n in bands:
        total = adler_combine(total, adler, n)
    return zlib_header(level) + b"".join(b for b, _, _ in bands) + struct.pack(">I", total)


# --- fast mode: matches at one fixed distance


def length_symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and extra value of each match length 0..258 (RFC 1951, 3.2.5)."""
    symbol, width, extra = (np.zeros(LONGEST + 1, np.int64) for _ in range(3))
    start = 3
    for s in range(257, 285):
        n = 0 if s < 265 else (s - 261) // 4
        for k in range(1 << n):
            if start + k <= LONGEST:
                symbol[start + k], width[start + k], extra[start + k] = s, n, k
        start += 1 << n
    symbol[LONGEST], width[LONGEST], extra[LONGEST] = 285, 0, 0
    return symbol, width, extra


LENGTH_SYMBOL, LENGTH_WIDTH, LENGTH_EXTRA = length_symbols()


def distance_symbol(distance: int) -> tuple[int, int, int]:
    """Symbol, extra bits and extra value of a match distance."""
    if distance <= 4:
        return distance - 1, 0, 0
    n = (distance - 1).bit_length() - 2
    return 2 * (n + 1) + (distance - 1 >> n & 1), n, distance - 1 & (1 << n) - 1


def fixed_matches(data: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Literals and matches at one distance: ``(values, is match)``.

    Bytes equal to those ``distance`` before them form islands; an island is cut
    into matches of at most 258 bytes and what is left below 3 stays literal.
    """
    n = len(data)
    same = np.zeros(n, bool)
    if distance < n:
        same[distance:] = data[distance:] == data[:-distance]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    pieces = -(-lengths // LONGEST)
    at = np.repeat(starts, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(LONGEST, np.repeat(starts + lengths, pieces) - at)
    at, size = at[size >= 3], size[size >= 3]
    covered = np.zeros(n + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    keep = np.cumsum(covered[:n]) == 0
    keep[at] = True
    values, matched = data.astype(np.int64), np.zeros(n, bool)
    values[at], matched[at] = size, True
    return values[keep], matched[keep]


def _block(values: np.ndarray, matched: np.ndarray, distance: int, final: bool) -> np.ndarray:
    """The bits of one block of tokens."""
    symbols = np.where(matched, LENGTH_SYMBOL[np.where(matched, values, 0)], values)
    ds, dn, dx = distance_symbol(distance)
    if len(values) < SMALL_BLOCK:
        lit = np.array([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8)
        dist = np.full(32, 5)
        head = [(int(final), 1), (1, 2)]
    else:
        counts = np.bincount(symbols, minlength=286)
        counts[256] += 1
        lit = limited_lengths(counts, 15)
        dist = limited_lengths(np.bincount([ds], minlength=30) if matched.any() else np.eye(30, dtype=int)[0], 15)
        head = [(int(final), 1), (2, 2), *dynamic_header(lit, dist)]
    codes, dcodes = canonical(lit), canonical(dist)
    stop = np.append(symbols, 256)
    m = np.append(matched, False)
    length = np.append(values, 0) * m
    # four fields for each token: code, length extra, distance code, distance extra
    fields = np.stack([codes[stop], LENGTH_EXTRA[length], np.full(len(stop), dcodes[ds]), np.full(len(stop), dx)], axis=1)
    widths = np.stack([lit[stop].astype(np.int64), LENGTH_WIDTH[length] * m, dist[ds] * m, dn * m], axis=1)
    hv, hn = zip(*head)
    return bits.code_bits(np.concatenate([hv, fields.ravel()]), np.concatenate([hn, widths.ravel()]))


def dynamic_header(lit: np.ndarray, dist: np.ndarray) -> list[tuple[int, int]]:
    """What follows the type of a dynamic block, as ``(value, bits)``."""
    n_lit = max(257, int(np.flatnonzero(lit).max()) + 1)
    n_dist = max(1, int(np.flatnonzero(dist).max(initial=0)) + 1)
    used = run_lengths([*lit[:n_lit], *dist[:n_dist]])
    lengths, codes = header_codes(used)
    n_code = max(4, max(k for k, s in enumerate(DEFLATE_ORDER) if lengths[s]) + 1)
    out = [(n_lit - 257, 5), (n_dist - 1, 5), (n_code - 4, 4)]
    out += [(int(lengths[s]), 3) for s in DEFLATE_ORDER[:n_code]]
    for s, extra, width in used:
        out += [(int(codes[s]), int(lengths[s])), (extra, width)]
    return out


def fast_deflate(data: bytes, distance: int, last: bool = True) -> bytes:
    """Raw deflate whose matches all lie ``distance`` bytes back; ends at a byte border."""
    values, matched = fixed_matches(np.frombuffer(data, np.uint8), distance)
    cuts = range(0, max(1, len(values)), BLOCK_TOKENS)
    out = [_block(values[a:a + BLOCK_TOKENS], matched[a:a + BLOCK_TOKENS], distance, last and a == cuts[-1]) for a in cuts]
    if not last:
        out.append(np.zeros(3, np.uint8))  # an empty stored block
    stream = bits.pack(np.concatenate(out))
    return stream if last else stream + b"\x00\x00\xff\xff"
