"""Bit streams: packing many codes at once, and joining streams off byte borders."""

from __future__ import annotations

import numpy as np


def code_bits(values: np.ndarray, widths: np.ndarray, msb_first: bool = False) -> np.ndarray:
    """The bits of many codes, one 0/1 byte each, in the order they are written."""
    widths = widths.astype(np.int64)
    total = int(widths.sum())
    owner = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    if msb_first:
        place = widths[owner] - 1 - place
    return ((values.astype(np.uint64)[owner] >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def pack(bits: np.ndarray, msb_first: bool = False, fill: int = 0) -> bytes:
    """Bits as bytes; the last byte is filled up with ``fill``."""
    rest = -len(bits) % 8
    if rest and fill:
        bits = np.concatenate([bits, np.full(rest, fill, np.uint8)])
    return np.packbits(bits, bitorder="big" if msb_first else "little").tobytes()


def splice(parts: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    """Least-significant-bit-first streams ``(bytes, bits)`` joined without gaps.

    Each part is shifted by the number of bits before it, so parts made apart
    from one another become one stream.
    """
    total = sum(n for _, n in parts)
    out = np.zeros((total + 15) // 8 + 1, np.uint8)
    at = 0
    for raw, n in parts:
        if not n:
            continue
        data = np.frombuffer(raw, np.uint8, (n + 7) // 8).astype(np.uint16)
        if n % 8:
            data[-1] &= (1 << n % 8) - 1
        byte, shift = divmod(at, 8)
        moved = data << shift
        out[byte:byte + len(data)] |= (moved & 0xFF).astype(np.uint8)
        out[byte + 1:byte + 1 + len(data)] |= (moved >> 8).astype(np.uint8)
        at += n
    return out[:(total + 7) // 8].tobytes(), total


class LsbReader:
    """Reads least-significant-bit-first streams (for checks of what was written)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for i in range(n):
            if self.at >> 3 >= len(self.data):
                raise EOFError
            value |= (self.data[self.at >> 3] >> (self.at & 7) & 1) << i
            self.at += 1
        return value
