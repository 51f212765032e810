"""Prefix codes: limited lengths, canonical codes, run-length coded lengths."""

from __future__ import annotations

import numpy as np

# The order in which deflate sends the lengths of its length code.
DEFLATE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
# The same for VP8L.
VP8L_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def limited_lengths(counts, limit: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit``; unused symbols get 0, a lone one 1.

    Package-merge: a symbol of length n takes part in n levels.  Each level's list
    is the symbols by count merged with pairs of the level below; going back from
    the 2n - 2 least of the top level tells how many symbols each level takes.
    Equal counts stand in the order of symbols, symbols before pairs.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no code of at most {limit} bits")
    by_count = used[np.argsort(counts[used], kind="stable")]
    weights = counts[by_count]
    level, is_symbol = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_symbol.append(order < n)
    taken = 2 * n - 2
    for kinds in reversed(is_symbol):
        symbols = int(np.count_nonzero(kinds[:taken]))
        lengths[by_count[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


def canonical(lengths, reverse: bool = True) -> np.ndarray:
    """Canonical codes by length, then symbol; bit-reversed for streams that begin with the low bit."""
    lengths = np.asarray(lengths, np.int64)
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    width = lengths[order]
    top = int(width.max())
    taken = np.int64(1) << (top - width)  # of the longest codes, those that begin with a code
    code = (np.cumsum(taken) - taken) >> (top - width)
    if reverse:
        turned = np.zeros_like(code)
        for bit in range(top):
            turned |= np.where(bit < width, (code >> bit & 1) << np.maximum(width - 1 - bit, 0), 0)
        code = turned
    codes[order] = code
    return codes


def run_lengths(lengths, repeat_first: int = 0) -> list[tuple[int, int, int]]:
    """Code lengths as ``(symbol, extra bits, their number)`` with the repeat symbols 16, 17 and 18.

    In deflate 16 repeats the length before it; in VP8L the last length that was
    not 0, and before any was sent ``repeat_first`` (8), which must then be given.
    A run too long for one repeat symbol is shared evenly among as few as it takes.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return []
    starts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
    value, run = lengths[starts], np.diff(np.append(starts, len(lengths)))
    zero = value == 0
    # what 16 would repeat at the start of each run: neighbours differ, so in deflate never the run's value
    said = np.concatenate([[repeat_first], value[~zero][:-1]]) if (~zero).any() else value[:0]
    lead = np.zeros(len(run), np.int64)
    lead[~zero] = value[~zero] != said if repeat_first else 1
    rest = run - lead
    repeats = np.where(rest >= 3, -(-rest // np.where(zero, 138, 6)), 0)
    plain = lead + np.where(rest < 3, rest, 0)
    of = np.repeat(np.arange(len(run)), plain + repeats)
    place = np.arange(len(of)) - np.repeat(np.cumsum(plain + repeats) - (plain + repeats), plain + repeats) - plain[of]
    size, more = np.divmod(rest[of], np.maximum(repeats[of], 1))
    size += place < more
    as_is = place < 0
    symbol = np.where(as_is, value[of], np.where(~zero[of], 16, np.where(size < 11, 17, 18)))
    extra = np.where(as_is, 0, size - np.where(symbol == 18, 11, 3))
    width = np.where(as_is, 0, np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7)))
    return list(zip(symbol.tolist(), extra.tolist(), width.tolist()))


def header_codes(used: list[tuple[int, int, int]], limit: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of the code that sends code lengths."""
    lengths = limited_lengths(np.bincount([s for s, _, _ in used], minlength=19), limit)
    return lengths, canonical(lengths)


def decode_table(lengths, reverse: bool = True) -> dict[tuple[int, int], int]:
    """``(length, code) -> symbol``, to read back what was written."""
    codes = canonical(lengths, reverse)
    return {(int(n), int(codes[s])): s for s, n in enumerate(lengths) if n}
