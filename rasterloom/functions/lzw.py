"""LZW as GIF and TIFF use it, in bands, and decoders to check them by.

Both formats share one parse.  The phrases of a dictionary are closed under
prefixes - a phrase enters it one value longer than one already there - so the
longest phrase at a place is found by bisection on its length.  A dictionary
is given up after a fixed number of phrases.  So a code's width follows from
its place in its table alone: widths and the codes between tables are laid out
afterwards, as arrays.
"""

from __future__ import annotations

import numpy as np

from . import bits

WIDEST = 12
_POWERS = 1 << np.arange(WIDEST + 1)


def phrases(data: bytes, first: int, room: int) -> list[int]:
    """Codes of the longest known phrases; new ones count from ``first``, and all are forgotten after ``room`` codes."""
    codes: list[int] = []
    at, end = 0, len(data)
    single = {bytes([v]): v for v in range(256)}
    while at < end:
        known, longest = dict(single), 1
        for fresh in range(first, first + room):
            fits, top = 1, min(longest, end - at)
            while fits < top:
                middle = (fits + top + 1) >> 1
                if data[at:at + middle] in known:
                    fits = middle
                else:
                    top = middle - 1
            codes.append(known[data[at:at + fits]])
            known[data[at:at + fits + 1]] = fresh
            longest = max(longest, fits + 1)
            at += fits
            if at >= end:
                break
    return codes


def _laid_out(codes: list[int], base: int, early: int, room: int, ending: int, leading: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths of a stream: tables of ``room`` codes, each closed by the clear code, the last by ``ending``.

    ``base`` values are literals, the clear code is the next number and the end
    code the one after.  A decoder that has read k codes of a table knows
    base + 2 + (k - 1) entries, and reads as many bits as that number has, or
    with ``early`` the next number.
    """
    codes = np.array(codes, np.int64)
    tables = max(1, -(-len(codes) // room))
    # one more place in each table for the code that closes it
    table = np.minimum(np.arange(len(codes)) // room, tables - 1)
    values = np.full(len(codes) + tables, base, np.int64)
    values[np.arange(len(codes)) + table] = codes
    values[-1] = ending
    places = np.arange(len(values)) % (room + 1)
    entries = base + 2 + np.maximum(places - 1, 0)
    widths = np.clip(np.searchsorted(_POWERS, entries + early, side="right"), np.searchsorted(_POWERS, base, side="right"), WIDEST)
    if leading:
        values, widths = np.insert(values, 0, base), np.insert(widths, 0, widths[0])
    return values, widths


def gif_band(data: bytes, literal_width: int, first: bool, last: bool) -> tuple[bytes, int]:
    """One band of a GIF stream as ``(bytes, bits)``, low bits first.

    The first band begins with a clear code; each but the last ends with one, so
    the next starts from an empty table at the smallest width; the last ends
    with the end code.  Raises ``ValueError`` for values outside the literals.
    """
    base = 1 << literal_width
    if data and max(data) >= base:
        raise ValueError("a value is outside the literal codes")
    room = (1 << WIDEST) - 1 - (base + 2)
    values, widths = _laid_out(phrases(data, base + 2, room), base, 0, room, base + 1 if last else base, first)
    stream = bits.code_bits(values, widths)
    return bits.pack(stream), len(stream)


def gif_decode(stream: bytes, literal_width: int) -> bytes:
    """The data of a whole GIF stream."""
    clear = 1 << literal_width
    reader, out = bits.LsbReader(stream), bytearray()
    table: list[bytes] = []
    width, before = literal_width + 1, b""
    while True:
        code = reader.take(width)
        if code == clear:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
            width, before = literal_width + 1, b""
            continue
        if code == clear + 1:
            return bytes(out)
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        if len(table) == 1 << width and width < 12:
            width += 1


def tiff_strip(data: bytes) -> bytes:
    """A strip as TIFF's LZW: high bits first, widths growing one code early."""
    room = (1 << WIDEST) - 2 - 258
    values, widths = _laid_out(phrases(data, 258, room), 256, 1, room, 257, True)
    return bits.pack(bits.code_bits(values, widths, msb_first=True), msb_first=True)


def tiff_decode(stream: bytes) -> bytes:
    """The data of a TIFF LZW strip."""
    whole = np.unpackbits(np.frombuffer(stream, np.uint8))
    at, width, out = 0, 9, bytearray()
    table: list[bytes] = []
    before = b""
    while True:
        code = int("".join(map(str, whole[at:at + width])), 2)
        at += width
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            return bytes(out)
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
