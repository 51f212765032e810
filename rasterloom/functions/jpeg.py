"""Baseline JPEG files, cut into restart intervals that are coded apart."""

from __future__ import annotations

import struct

import numpy as np

from . import bits, blocks
from .prefix_codes import canonical

# The standard's annex K codes - how many of each length, and their symbols.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    (
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
        0x81, 0x91, 0xa1, 0x08, 0x23, 0x42, 0xb1, 0xc1, 0x15, 0x52, 0xd1, 0xf0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0a, 0x16,
        0x17, 0x18, 0x19, 0x1a, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3a, 0x43, 0x44, 0x45,
        0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69,
        0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92, 0x93, 0x94,
        0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0xa2, 0xa3, 0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4, 0xb5, 0xb6,
        0xb7, 0xb8, 0xb9, 0xba, 0xc2, 0xc3, 0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6, 0xd7, 0xd8,
        0xd9, 0xda, 0xe1, 0xe2, 0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf1, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8,
        0xf9, 0xfa,
    ),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    (
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81,
        0x08, 0x14, 0x42, 0x91, 0xa1, 0xb1, 0xc1, 0x09, 0x23, 0x33, 0x52, 0xf0, 0x15, 0x62, 0x72, 0xd1, 0x0a, 0x16, 0x24, 0x34,
        0xe1, 0x25, 0xf1, 0x17, 0x18, 0x19, 0x1a, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3a, 0x43, 0x44,
        0x45, 0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68,
        0x69, 0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92,
        0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0xa2, 0xa3, 0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4,
        0xb5, 0xb6, 0xb7, 0xb8, 0xb9, 0xba, 0xc2, 0xc3, 0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6,
        0xd7, 0xd8, 0xd9, 0xda, 0xe2, 0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8,
        0xf9, 0xfa,
    ),
)
SPECS = {(0, 0): DC_LUMA, (1, 0): AC_LUMA, (0, 1): DC_CHROMA, (1, 1): AC_CHROMA}


def code_table(spec) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes by symbol, of a table given as counts and symbols.

    Codes ascend in the order of the symbols listed, which within a length need not be ascending.
    """
    counts, symbols = spec
    listed = np.repeat(np.arange(1, 17), counts)
    codes = canonical(listed, reverse=False)
    lengths, values = np.zeros(256, np.int64), np.zeros(256, np.int64)
    lengths[list(symbols)], values[list(symbols)] = listed, codes
    return lengths, values


TABLES = {k: code_table(v) for k, v in SPECS.items()}


def planes_of(pixels: np.ndarray, model: str, subsample: bool = True) -> list[np.ndarray]:
    """Planes as they are coded: luma, and chroma at half size."""
    if model == "gray":
        return [pixels.reshape(pixels.shape[:2])]
    ycc = pixels if model == "ycbcr" else blocks.rgb_to_ycbcr(pixels[..., :3])
    return [ycc[..., 0], *(blocks.halved(ycc[..., i]) if subsample else ycc[..., i] for i in (1, 2))]


def zigzagged(plane: np.ndarray, table: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Quantised blocks of a plane, filled up to so many block rows and columns."""
    plane = np.pad(plane, ((0, rows * 8 - plane.shape[0]), (0, columns * 8 - plane.shape[1])), mode="edge")
    q = blocks.quantise(blocks.fixed_dct(blocks.to_blocks(plane)), table)
    return q.reshape(rows, columns, 64)[..., blocks.ZIGZAG]


def interval(units: list[tuple[np.ndarray, int]]) -> bytes:
    """The entropy-coded data of one restart interval.

    ``units`` has, for each component, its blocks in scan order as ``(MCU, block in
    the MCU, 64)`` with the number of its tables.
    """
    rows = []
    for component, (zz, kind) in enumerate(units):
        n_mcu, per, _ = zz.shape
        block, place, symbol, value, width = blocks.block_symbols(zz.reshape(-1, 64))
        for c in (0, 1):
            here = (place > 0) == bool(c)
            lengths, codes = TABLES[c, kind]
            key = (block[here] // per * 100 + component * 10 + block[here] % per) * 1000 + place[here]
            rows.append((key, codes[symbol[here]], lengths[symbol[here]], value[here], width[here]))
    key, code, length, value, width = (np.concatenate(c) for c in zip(*rows))
    order = np.argsort(key, kind="stable")
    values = np.stack([code[order], value[order]], axis=1).ravel()
    widths = np.stack([length[order], width[order]], axis=1).ravel()
    packed = bits.pack(bits.code_bits(values, widths, msb_first=True), msb_first=True, fill=1)
    return packed.replace(b"\xff", b"\xff\x00")


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def interval_rows(mcu_rows: int, mcus_per_row: int, n_workers: int, least: int = 4, per_worker: int = 2) -> int:
    """MCU rows of each restart interval, of which two bytes must hold the MCUs."""
    n = 1 if n_workers <= 1 else max(1, min(n_workers * per_worker, mcu_rows // least))
    k = -(-mcu_rows // n)
    return 0xFFFF // mcus_per_row if k * mcus_per_row > 0xFFFF else k


def encode(pixels: np.ndarray, model: str = "rgb", quality: int = 75, n_workers: int = 1, subsample: bool = True) -> bytes:
    """A baseline file: gray, or colour with chroma at half size."""
    h, w = pixels.shape[:2]
    if not 0 < h < 1 << 16 or not 0 < w < 1 << 16:
        raise ValueError("the size of an image is from 1 to 65535 a side")
    tables = [blocks.quality_table(blocks.LUMA, quality), blocks.quality_table(blocks.CHROMA, quality)]
    planes = planes_of(pixels, model, subsample)
    step = 2 if len(planes) == 3 and subsample else 1
    mcu_rows, mcus = -(-h // (8 * step)), -(-w // (8 * step))
    units = []
    for k, plane in enumerate(planes):
        s = step if k == 0 else 1
        zz = zigzagged(plane, tables[min(k, 1)], mcu_rows * s, mcus * s)
        zz = zz.reshape(mcu_rows, s, mcus, s, 64).transpose(0, 2, 1, 3, 4).reshape(mcu_rows, mcus, s * s, 64)
        units.append((zz, min(k, 1)))
    per = interval_rows(mcu_rows, mcus, n_workers)
    scan = []
    for i, y in enumerate(range(0, mcu_rows, per)):
        if i:
            scan.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
        scan.append(interval([(zz[y:y + per].reshape(-1, zz.shape[2], 64), kind) for zz, kind in units]))
    used = range(2 if len(planes) == 3 else 1)
    out = [b"\xff\xd8", *(_segment(0xDB, bytes([k]) + tables[k][blocks.ZIGZAG].astype(np.uint8).tobytes()) for k in used)]
    parts = [bytes([k + 1, (step << 4 | step) if k == 0 else 0x11, min(k, 1)]) for k in range(len(planes))]
    out.append(_segment(0xC0, struct.pack(">B2HB", 8, h, w, len(planes)) + b"".join(parts)))
    for k in used:
        for c in (0, 1):
            counts, symbols = SPECS[c, k]
            out.append(_segment(0xC4, bytes([c << 4 | k, *counts, *symbols])))
    if per < mcu_rows:
        out.append(_segment(0xDD, struct.pack(">H", per * mcus)))
    out.append(_segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(len(planes))) + b"\x00\x3f\x00"))
    return b"".join([*out, *scan, b"\xff\xd9"])
