"""TIFF files: strips, predictor, directory."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import lzw
from .bands import split
from .predictors import horizontal

STRIP_BYTES, PER_WORKER = 256 << 10, 2
SHORT, LONG, RATIONAL, UNDEFINED = 3, 4, 5, 7
COMPRESSION = {"none": 1, "lzw": 5, "deflate": 8}
SIZES = {SHORT: 2, LONG: 4, RATIONAL: 8, UNDEFINED: 1}


def strip(raw: bytes, compression: str) -> bytes:
    """A strip's bytes, compressed."""
    return {"none": bytes, "deflate": zlib.compress, "lzw": lzw.tiff_strip}[compression](raw)


def directory(at: int, entries: list[tuple[int, int, list | bytes]]) -> bytes:
    """The directory that stands at offset ``at``: entries by tag, long values after it."""
    entries = sorted(entries, key=lambda e: e[0])
    beyond = at + 2 + 12 * len(entries) + 4
    head, tail = [struct.pack("<H", len(entries))], []
    for tag, kind, value in entries:
        if kind == UNDEFINED:
            raw, n = bytes(value), len(value)
        elif kind == RATIONAL:
            raw, n = struct.pack(f"<{len(value)}I", *value), len(value) // 2
        else:
            raw, n = struct.pack(f"<{len(value)}{'H' if kind == SHORT else 'I'}", *value), len(value)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack("<I", beyond)
            raw += b"\0" * (len(raw) % 2)
            tail.append(raw)
            beyond += len(raw)
        head.append(struct.pack("<HHI", tag, kind, n) + field)
    return b"".join([*head, bytes(4), *tail])


def strip_rows(height: int, row_bytes: int, n_workers: int, strip_bytes: int = STRIP_BYTES) -> int:
    """Rows of each strip but the last."""
    cuts = split(height, max(1, -(-strip_bytes // row_bytes)), 1, n_workers, PER_WORKER)
    return cuts[1] - cuts[0]


def sample_rows(pixels: np.ndarray, predictor: bool) -> np.ndarray:
    """Rows of little-endian samples, as differences if asked for."""
    h, w, c = pixels.shape
    rows = np.ascontiguousarray(pixels.reshape(h, w * c).astype("<u2" if pixels.dtype.itemsize == 2 else np.uint8))
    return horizontal(rows, c) if predictor else rows


def encode(pixels: np.ndarray, model: str, compression: str = "deflate", predictor: bool = False, palette=(), icc: bytes = b"", n_workers: int = 1, strip_bytes: int = STRIP_BYTES) -> bytes:
    """The file of an image ``(h, w, samples)``: gray, rgb, rgba, nrgba, cmyk or paletted."""
    h, w, c = pixels.shape
    if not h or not w:
        raise ValueError("an image has at least one pixel")
    width = pixels.dtype.itemsize
    if w * c * width * h >= 1 << 31:
        raise ValueError("the image is too large")
    predictor = predictor and compression != "none" and model != "paletted"
    rows = sample_rows(pixels, predictor)
    per = strip_rows(h, w * c * width, n_workers, strip_bytes)
    strips = [strip(rows[y:y + per].tobytes(), compression) for y in range(0, h, per)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    if at >= 1 << 32:
        raise ValueError("the file is too large")
    photometric = {"gray": 1, "paletted": 3, "cmyk": 5}.get(model, 2)
    size = LONG if max(per, w, h) > 0xFFFF else SHORT
    entries = [
        (256, size, [w]), (257, size, [h]), (258, SHORT, [8 * width] * c), (259, SHORT, [COMPRESSION[compression]]),
        (262, SHORT, [photometric]), (273, LONG, offsets), (277, SHORT, [c]), (278, size, [per]), (279, LONG, list(map(len, strips))),
        (282, RATIONAL, [72, 1]), (283, RATIONAL, [72, 1]), (296, SHORT, [2]),
    ]
    if predictor:
        entries.append((317, SHORT, [2]))
    if model == "paletted":
        table = np.zeros((3, 256), np.int64)
        table[:, :len(palette)] = np.array([p[:3] for p in palette]).T * 257
        entries.append((320, SHORT, table.ravel().tolist()))
    if model in ("rgba", "nrgba"):
        entries.append((338, SHORT, [1 if model == "rgba" else 2]))
    if model == "cmyk":
        entries.append((332, SHORT, [1]))
    if icc:
        entries.append((34675, UNDEFINED, icc))
    where = at + at % 2
    return b"".join([b"II*\0", struct.pack("<I", where), *strips, bytes(at % 2), directory(where, entries)])


def parse(file: bytes) -> tuple[dict[int, list], list[bytes]]:
    """Directory values by tag, and the strips as they are stored."""
    if file[:4] != b"II*\0":
        raise ValueError("no little-endian TIFF")
    (at,) = struct.unpack_from("<I", file, 4)
    (n,) = struct.unpack_from("<H", file, at)
    out: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from("<HHI", file, at + 2 + 12 * k)
        size = SIZES[kind] * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from("<I", file, at + 10 + 12 * k)[0]
        letter = {SHORT: "H", LONG: "I", RATIONAL: "I", UNDEFINED: "B"}[kind]
        out[tag] = list(struct.unpack_from(f"<{count * (2 if kind == RATIONAL else 1)}{letter}", file, where))
    return out, [file[o:o + c] for o, c in zip(out[273], out[279])]


def decode(file: bytes) -> np.ndarray:
    """The samples of a file written by ``encode`` (for checks)."""
    from .predictors import undo_horizontal

    tags, strips = parse(file)
    undo = {1: bytes, 5: lzw.tiff_decode, 8: zlib.decompress}[tags[259][0]]
    raw = b"".join(map(undo, strips))
    c = tags[277][0]
    rows = np.frombuffer(raw, "<u2" if tags[258][0] == 16 else np.uint8).reshape(tags[257][0], tags[256][0] * c)
    return (undo_horizontal(rows, c) if 317 in tags else rows).reshape(tags[257][0], tags[256][0], c)
