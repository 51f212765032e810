"""8 x 8 block transforms and the symbols a baseline scan is made of."""

from __future__ import annotations

import numpy as np

# The base quantisation tables of the JPEG standard's annex K, natural order.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
], np.int64)
CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
], np.int64)


def zigzag() -> np.ndarray:
    """Natural index of each place along the zig-zag: diagonals, turning at each end."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    along = lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1])
    return np.array([y * 8 + x for y, x in sorted(cells, key=along)])


ZIGZAG = zigzag()


def quality_table(base: np.ndarray, quality: int) -> np.ndarray:
    """A base table scaled to a quality from 1 to 100."""
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def _basis() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


BASIS = _basis()


def forward_dct(blocks: np.ndarray) -> np.ndarray:
    """Orthonormal DCT of blocks ``(..., 8, 8)``."""
    return BASIS @ blocks @ BASIS.T


def inverse_dct(coefficients: np.ndarray) -> np.ndarray:
    return BASIS.T @ coefficients @ BASIS


# The fixed-point DCT as two integer matrices a pass: sums and differences of mirrored
# samples, then rotations with constants of so many bits.  Coefficients come out times 8.
FOLD = np.array([
    [1, 1, 1, 1, 1, 1, 1, 1],
    [1, -1, -1, 1, 1, -1, -1, 1],
    [0, 1, -1, 0, 0, -1, 1, 0],
    [1, 0, 0, -1, -1, 0, 0, 1],
    [0, 0, 0, 1, -1, 0, 0, 0],
    [0, 0, 1, 0, 0, -1, 0, 0],
    [0, 1, 0, 0, 0, 0, -1, 0],
    [1, 0, 0, 0, 0, 0, 0, -1],
], np.int64)
ROOTED = (3, 5)  # these are multiplied by the square root of 2 afterwards, once cut


def root_2(bits: int) -> int:
    return round(np.sqrt(2) * (1 << bits))


def rotation(bits: int) -> np.ndarray:
    """From folded samples to coefficients in order; 0 and 4 need no constant and are left as they are."""
    at = lambda f, k, by=1.0: round(by * f(k * np.pi / 16) * (1 << bits))
    c1, s1, c3, s3 = at(np.cos, 1), at(np.sin, 1), at(np.cos, 3), at(np.sin, 3)
    c6, s6 = at(np.cos, 6, np.sqrt(2)), at(np.sin, 6, np.sqrt(2))
    turn = np.zeros((8, 8), np.int64)
    turn[0, 0] = turn[4, 1] = 1
    turn[2, 2:4], turn[6, 2:4] = (c6, s6), (-s6, c6)
    turn[1, 4:] = c3 - s3, c1 - s1, c1 + s1, c3 + s3
    turn[7, 4:] = -c3 - s3, c1 + s1, s1 - c1, c3 - s3
    turn[3, 4:] = -s3, -c1, -s1, c3
    turn[5, 4:] = c3, s1, -c1, s3
    return turn


def fixed_dct(samples: np.ndarray) -> np.ndarray:
    """The DCT of blocks ``(..., 8, 8)`` of samples 0..255, less 128, in integers: eight times the orthonormal one."""
    columns = rotation(18) @ (FOLD @ samples.astype(np.int64))
    columns[..., 0, :] -= 128 * 8
    columns[..., (0, 4), :] <<= 18
    columns[..., ROOTED, :] = (columns[..., ROOTED, :] >> 12) * root_2(12)
    folded = FOLD @ columns.swapaxes(-1, -2)
    folded[..., 2:, :] >>= 14
    rows = rotation(14) @ folded
    rows[..., ROOTED, :] = (rows[..., ROOTED, :] >> 14) * root_2(14)
    return ((rows + (1 << 17)) >> 18).swapaxes(-1, -2)


def quantise(scaled: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Coefficients times 8, as ``fixed_dct`` gives them, over 8 times the table, rounded half away from zero."""
    divisor = table.reshape(8, 8) * 8
    return np.sign(scaled) * ((np.abs(scaled) + divisor // 2) // divisor)


def rgb_to_ycbcr(rgb: np.ndarray) -> np.ndarray:
    """JFIF colours in 16-bit fixed point, rounded, clamped."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    y = (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
    cb = ((-11056 * r - 21712 * g + 32768 * b + 32768) >> 16) + 128
    cr = ((32768 * r - 27440 * g - 5328 * b + 32768) >> 16) + 128
    return np.clip(np.stack([y, cb, cr], axis=-1), 0, 255)


def to_blocks(plane: np.ndarray) -> np.ndarray:
    """A plane cut into 8 x 8 blocks ``(rows, columns, 8, 8)``; edges repeat the last sample."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def halved(plane: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 samples, rounded; odd edges repeat."""
    plane = np.pad(plane, ((0, plane.shape[0] % 2), (0, plane.shape[1] % 2)), mode="edge").astype(np.int64)
    return (plane[::2, ::2] + plane[1::2, ::2] + plane[::2, 1::2] + plane[1::2, 1::2] + 2) >> 2


def magnitude_bits(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude of each value; 0 has none."""
    v = np.abs(v).astype(np.int64)
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) + 1, 0)


def block_symbols(zz: np.ndarray, dc_before: int = 0):
    """Symbols of quantised zig-zag blocks ``(n, 64)`` in scan order.

    Returns arrays ``(block, place, symbol, extra value, extra bits)``: place 0 is
    the DC difference, the AC symbols are run * 16 + size with 0xF0 for sixteen
    zeros and 0 for the end of a block.
    """
    n = len(zz)
    dc = np.diff(zz[:, 0], prepend=dc_before)
    size = magnitude_bits(dc)
    rows = [(np.arange(n), np.zeros(n, np.int64), size, np.where(dc < 0, dc - 1, dc) & ((1 << size) - 1), size)]
    block, place = np.nonzero(zz[:, 1:])
    place = place + 1
    value = zz[block, place].astype(np.int64)
    first = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
    before = np.where(first, 0, np.append(0, place[:-1])) if len(block) else place
    run = place - before - 1
    size = magnitude_bits(value)
    rows.append((block, place * 4 + 3, (run % 16) * 16 + size, np.where(value < 0, value - 1, value) & ((1 << size) - 1), size))
    for k in range(3):  # up to three times sixteen zeros before a value
        some = run // 16 > k
        zeros = np.zeros(int(some.sum()), np.int64)
        rows.append((block[some], place[some] * 4 + k, zeros + 0xF0, zeros, zeros))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    zeros = np.zeros(len(ends), np.int64)
    rows.append((ends, zeros + 64 * 4, zeros, zeros, zeros))
    columns = [np.concatenate(c) for c in zip(*rows)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)
