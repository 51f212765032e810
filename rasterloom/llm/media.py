"""Byte payloads in ISO media containers, and features read from the boxes alone.

``pack`` stores a payload losslessly as 8-bit grey video frames of 24 x 24
samples (576 bytes each) in one self-contained file: ``ftyp``, ``moov`` with a
full sample table, ``mdat``.  ``inspect`` walks the nested boxes of such a file
- or of any file of this family with sample tables - and decodes ``stsd``,
``stts``, ``stss``, ``stsc``, ``stsz`` and ``stco``/``co64`` into codec,
duration and the byte ranges of the key frames; it never looks into ``mdat``.

Defined results: a null or empty payload is one frame of padding; equal
payloads give equal files; a file that is no container, or a damaged one, raises
``ValueError`` in ``inspect``: every count in it is held against its box before
anything of that size is made, and every sample against the file.  In ``features``
such a file is a row with its ``error`` and no features; it fails no job.  The
operator reads the id and the text only, row by row, so repeated rows are repeated
and empty tables stay empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import as_bytes, map_batches, written

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
TIMESCALE = 25
DEEPEST = 16
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"edts"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(raw: bytes) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of a frame."""
    return raw + PAD * (-len(raw) % FRAME if raw else FRAME)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pack(raw: bytes) -> bytes:
    """The container file of a payload."""
    data = padded(raw)
    frames = len(data) // FRAME
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2", b"qt  ")
    long = len(data) + 16 > 0xFFFFFFFF

    def moov(first: int) -> bytes:
        entry = struct.pack(">6xH2H3I2H2IIH32sHh", 1, 0, 0, 0, 0, 0, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 40, -1)
        stsd = _full(b"stsd", 0, struct.pack(">I", 1), _box(b"raw ", entry))
        stts = _full(b"stts", 0, struct.pack(">3I", 1, frames, 1))
        stsc = _full(b"stsc", 0, struct.pack(">4I", 1, 1, frames, 1))
        stsz = _full(b"stsz", 0, struct.pack(">2I", FRAME, frames))
        stco = _full(b"co64", 0, struct.pack(">IQ", 1, first)) if long else _full(b"stco", 0, struct.pack(">2I", 1, first))
        dinf = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        minf = _box(b"minf", _full(b"vmhd", 1, bytes(8)), dinf, _box(b"stbl", stsd, stts, stsc, stsz, stco))
        mdhd = _full(b"mdhd", 0, struct.pack(">4I2H", 0, 0, TIMESCALE, frames, 0x55C4, 0))
        hdlr = _full(b"hdlr", 0, b"mhlr", b"vide", bytes(13))
        tkhd = _full(b"tkhd", 7, struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16))
        trak = _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf))
        mvhd = _full(b"mvhd", 0, struct.pack(">4IIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        # the unpadded length, as user data
        return _box(b"moov", mvhd, trak, _box(b"udta", _box(b"nbyt", struct.pack(">Q", len(raw)))))

    head = struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) if long else struct.pack(">I4s", len(data) + 8, b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(first), head, data))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, outer before inner, as (path, first byte, end) of their bodies."""
    end = len(data) if end is None else end
    if len(path) > DEEPEST:
        raise ValueError("boxes are nested too deep")
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), body, start + size
        if kind in _CONTAINERS:
            yield from boxes(data, body, start + size, (*path, kind))
        start += size


def _table(data: memoryview, span: tuple[int, int], columns: int, width: str = ">u4") -> np.ndarray:
    """The rows of a full box that holds their number and then them."""
    at, end = span
    if end - at < 8:
        raise ValueError("a table is cut off")
    (n,) = struct.unpack_from(">I", data, at + 4)
    if n * columns * np.dtype(width).itemsize > end - at - 8:
        raise ValueError("a table says it has more rows than its box")
    return np.frombuffer(data, width, n * columns, at + 8).reshape(n, columns).astype(np.int64)


def sample_ranges(tables: dict[bytes, tuple[int, int]], data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all samples, from the chunk and size tables."""
    at, end = tables[b"stsz"]
    if end - at < 12:
        raise ValueError("a table is cut off")
    fixed, n = struct.unpack_from(">2I", data, at + 4)
    if n * fixed > len(data) or not fixed and 4 * n > end - at - 12:
        raise ValueError("there are more samples than the file can hold")
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    if b"co64" in tables:
        chunks = _table(data, tables[b"co64"], 1, ">u8")[:, 0]
    elif b"stco" in tables:
        chunks = _table(data, tables[b"stco"], 1)[:, 0]
    else:
        raise ValueError("no chunk offsets")
    runs = _table(data, tables[b"stsc"], 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(runs) and runs[0, 0] != 1 or (spans < 1).any() or (runs[:, 1] > n).any() or sum(map(int.__mul__, spans.tolist(), runs[:, 1].tolist())) != n:
        raise ValueError("chunks and samples do not agree")
    per_chunk = np.repeat(runs[:, 1], spans)
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk_of] + before - before[firsts[chunk_of]]
    if len(offsets) and offsets.min() < 0:
        raise ValueError("a sample lies outside the file")
    return offsets, sizes


def inspect(file: bytes) -> dict:
    """Codec, times and key-frame byte ranges of the first track, payload unread.

    Adjoining key frames share a range ``(offset, length, frames)``.
    """
    try:
        return _inspect(memoryview(file))
    except (struct.error, IndexError, KeyError, OverflowError) as e:
        raise ValueError(f"a damaged container: {e!r}") from e


def _inspect(data: memoryview) -> dict:
    tables: dict[bytes, tuple[int, int]] = {}
    out: dict = {"n_bytes": None}
    tracks = 0
    for path, a, b in boxes(data):
        kind = path[-1]
        tracks += kind == b"trak"
        if kind == b"nbyt":
            (out["n_bytes"],) = struct.unpack_from(">Q", data[:b], a)
        if tracks != 1:
            continue
        if path[-2:-1] == (b"stbl",):
            tables[kind] = (a, b)
        elif kind == b"mdhd":
            wide = data[a] == 1
            out["timescale"], out["duration"] = struct.unpack_from(">IQ" if wide else ">2I", data[:b], a + (20 if wide else 12))
    if not {b"stsd", b"stsz", b"stsc", b"stts"} <= tables.keys():
        raise ValueError("no sample tables")
    if not out.get("timescale"):
        raise ValueError("no time scale")
    at, end = tables[b"stsd"]
    if end - at < 44:
        raise ValueError("no sample description")
    out["codec"] = bytes(data[at + 12:at + 16]).decode("latin-1").strip()
    out["width"], out["height"] = struct.unpack_from(">2H", data, at + 40)
    offsets, sizes = sample_ranges(tables, data)
    out["samples"] = len(sizes)
    deltas = _table(data, tables[b"stts"], 2)
    out["ticks"] = sum(map(int.__mul__, deltas[:, 0].tolist(), deltas[:, 1].tolist()))
    keys = _table(data, tables[b"stss"], 1)[:, 0] - 1 if b"stss" in tables else np.arange(len(sizes))
    if len(keys) and not 0 <= keys.min() <= keys.max() < len(sizes):
        raise ValueError("a key frame is no sample")
    starts, lengths = offsets[keys], sizes[keys]
    new = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + lengths[:-1])) if len(keys) else np.array([], int)
    ends = np.append(new[1:], len(keys))
    out["key_ranges"] = [(int(starts[i]), int(lengths[i:j].sum()), int(j - i)) for i, j in zip(new, ends)]
    out["all_ranges"] = (offsets, sizes)
    return out


def unpack(file: bytes, info: dict | None = None) -> bytes:
    """The padded payload, gathered from the sample ranges, which must lie in the file.

    Tables alone can be inspected: only here are the samples themselves needed.
    """
    offsets, sizes = (info or inspect(file))["all_ranges"]
    if (offsets > len(file) - sizes).any():
        raise ValueError("a sample lies outside the file")
    if len(sizes) and (offsets[1:] == offsets[:-1] + sizes[:-1]).all():
        return file[int(offsets[0]):int(offsets[-1] + sizes[-1])]
    return b"".join(file[o:o + s] for o, s in zip(offsets.tolist(), sizes.tolist()))


def feature(info: dict) -> str:
    """The features of a file as one line."""
    ranges = ",".join(f"{a}+{n}x{k}" for a, n, k in info["key_ranges"])
    return f"{info['codec']};{info['width']}x{info['height']};{info['ticks']}/{info['timescale']};{info['samples']};{ranges}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media)``: the container of each text, written to shared storage."""
    source = docs.select(docs[id_col], docs[text_col])

    def run(batch: pa.RecordBatch):
        # by slices: a file is as large as its text, and a batch may hold many
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            files = [pack(x) for x in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])

    made = map_batches(source, run, f"doc_id {dict(source.dtypes)[id_col]}, media binary")
    return written(made, "media", "zstd")


def features(stored: DataFrame) -> DataFrame:
    """Features of stored containers, and the payload's own figures, per row."""

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for file in part.column(1).to_pylist():
                try:
                    if file is None:
                        raise ValueError("no file")
                    info = inspect(file)
                    payload = unpack(file, info)
                    rows.append((info["n_bytes"], payload, zlib.crc32(payload[-32:]), feature(info), info["codec"], info["ticks"] / info["timescale"], None))
                except ValueError as e:
                    rows.append((*[None] * 6, str(e)))
            columns = list(zip(*rows))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "media", "n_bytes", "payload", "tail_crc32", "feature", "codec", "seconds", "error"],
            )

    id_type = dict(stored.dtypes)["doc_id"]
    return map_batches(stored, run, f"doc_id {id_type}, media binary, n_bytes long, payload binary, tail_crc32 long, feature string, codec string, seconds double, error string")
