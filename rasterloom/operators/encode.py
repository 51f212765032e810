"""Files made of images, one image or animation a row, bands of large ones apart.

Batches go in parallel over images.  An image that is too large for one task is
cut by ``png_bands``: rows are grouped by band with the rows above them as a
halo, bands are filtered and deflated on their own and joined in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import deflate, gif, jpeg, lzw, png, prefix_codes, tiff, vp8l, webp
from .images import as_rows


def each(images: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``(image_id, file)`` by a function of an image's rows of bytes.

    An image that cannot be encoded has a null file and its ``error``.
    """
    id_type = dict(images.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                files, errors = [], []
                for width, raw in zip(part.column(1).to_pylist(), part.column(2)):
                    try:
                        files.append(make(as_rows(raw.as_buffer(), width)))
                        errors.append(None)
                    except ValueError as e:
                        files.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=["image_id", "file", "error"])

    return images.select("image_id", "row_bytes", "raw").mapInArrow(run, f"image_id {id_type}, file binary, error string")


def need_rows(rows: np.ndarray) -> np.ndarray:
    if not len(rows):
        raise ValueError("an image has at least one row")
    return rows


def png_files(images: DataFrame, options: png.Options = png.Options()) -> DataFrame:
    """Images of gray bytes as PNG files."""
    return each(images, lambda rows: png.encode(rows, png.layout_of("gray", rows.shape[1], len(need_rows(rows)), True), options))


def tiff_files(images: DataFrame, compression: str, predictor: bool, workers: int = 1, strip_bytes: int = tiff.STRIP_BYTES) -> DataFrame:
    """Images of gray bytes as TIFF files."""
    return each(images, lambda rows: tiff.encode(need_rows(rows)[..., None], "gray", compression, predictor, n_workers=workers, strip_bytes=strip_bytes))


def gif_files(images: DataFrame, workers: int = 1, band_pixels: int = gif.BAND_PIXELS) -> DataFrame:
    """Images of bytes as GIF files with a palette of 256 grays."""
    palette = tuple((v, v, v, 255) for v in range(256))
    return each(images, lambda rows: gif.encode([gif.Frame(need_rows(rows), palette)], rows.shape[1], len(rows), n_workers=workers, band_pixels=band_pixels))


def jpeg_files(images: DataFrame, quality: int = 75, workers: int = 1) -> DataFrame:
    """Images of R, G, B bytes (rows a multiple of three) as JPEG files."""
    return each(images, lambda rows: jpeg.encode(need_rows(rows)[:, :rows.shape[1] // 3 * 3].reshape(len(rows), -1, 3), "rgb", quality, workers))


def webp_files(images: DataFrame, workers: int = 1) -> DataFrame:
    """Images of A, R, G, B bytes as WebP files."""
    return each(images, lambda rows: webp.encode(need_rows(rows).reshape(len(rows), -1, 4), workers))


def band_streams(images: DataFrame, options: png.Options) -> DataFrame:
    """``(image_id, band, y0, y1, data, adler, n)``: an image's deflated bands, each on its own."""
    id_type = dict(images.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            for k, (width, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                rows = as_rows(raw.as_buffer(), width)
                if not len(rows):
                    continue
                layout = png.layout_of("gray", width, len(rows), True)
                cuts = png.image_bands(layout, options)
                made = [png.encode_band(rows, a, b, layout, options) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k] * len(made))), pa.array(range(len(made)), pa.int32()), pa.array([b.first for b in made], pa.int64()), pa.array([b.stop for b in made], pa.int64()),
                        pa.array([b.data for b in made], pa.binary()), pa.array([b.adler for b in made], pa.int64()), pa.array([b.length for b in made], pa.int64()),
                    ],
                    names=["image_id", "band", "y0", "y1", "data", "adler", "n"],
                )

    return images.select("image_id", "row_bytes", "raw").mapInArrow(run, f"image_id {id_type}, band int, y0 long, y1 long, data binary, adler long, n long")


def png_bands(rows: DataFrame, heights: DataFrame, row_bytes: int, band_rows: int, options: png.Options = png.Options()) -> DataFrame:
    """PNG files of images given as rows ``(image_id, y, raw)``, a task a band.

    ``heights`` has ``(image_id, height)``.  Every row goes to its band and, as a
    halo, to the next one if that one's dictionary or first row needs it; a band
    is then encoded without any other.  Files are joined from the bands in order.
    """
    halo = -(-deflate.WINDOW // (row_bytes + 1)) + 1
    reach = -(-halo // band_rows)
    id_type = dict(rows.dtypes)["image_id"]
    band = F.floor(F.col("y") / band_rows).cast("int")
    known = rows.join(heights, "image_id").withColumn("own", band)
    last = F.floor((F.col("height") - 1) / band_rows).cast("int")
    # a row serves its own band and those after it whose halo it is in
    copies = F.filter(F.sequence(F.col("own"), F.least(F.col("own") + reach, last)), lambda b: (b == F.col("own")) | (F.col("y") >= b * band_rows - halo))
    dealt = known.select("image_id", "height", F.explode(copies).alias("band"), "y", "raw")

    def make(key, group):
        table = group.combine_chunks() if hasattr(group, "combine_chunks") else group
        order = np.argsort(np.asarray(table.column("y")))
        ys = np.asarray(table.column("y"))[order]
        raws = table.column("raw").to_pylist()
        data = np.frombuffer(b"".join(raws[i] for i in order), np.uint8).reshape(len(ys), row_bytes)
        height, band_no = int(table.column("height")[0].as_py()), int(key[1].as_py())
        y0, y1, top = band_no * band_rows, min(height, (band_no + 1) * band_rows), int(ys[0])
        layout = png.layout_of("gray", row_bytes, height - top, True)
        b = png.encode_band(data, y0 - top, y1 - top, layout, options)
        return pa.table({"image_id": [key[0].as_py()], "band": pa.array([band_no], pa.int32()), "height": pa.array([height], pa.int64()), "data": pa.array([b.data], pa.binary()), "adler": pa.array([b.adler], pa.int64()), "n": pa.array([b.length], pa.int64())})

    made = dealt.groupBy("image_id", "band").applyInArrow(make, f"image_id {id_type}, band int, height long, data binary, adler long, n long")
    parts = made.groupBy("image_id").agg(F.max("height").alias("height"), F.sort_array(F.collect_list(F.struct("band", "data", "adler", "n"))).alias("parts"))

    def join(batches):
        for batch in batches:
            files = []
            for height, bands in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                layout = png.layout_of("gray", row_bytes, height, True)
                stream = deflate.join_bands([(b["data"], b["adler"], b["n"]) for b in bands], options.level)
                files.append(png.SIGNATURE + png.header_chunks(layout) + png.idat(stream) + png.chunk(b"IEND"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["image_id", "file"])

    return parts.mapInArrow(join, f"image_id {id_type}, file binary")


def huffman_lengths(counts: DataFrame, key: str, symbol: str, n: str, size: int, limit: int) -> DataFrame:
    """``(key, symbol, bits, code)``: limited lengths and codes of each key's counts.

    An alphabet is a short list, made one array by an aggregation before Python sees it.
    """
    listed = counts.groupBy(key).agg(F.collect_list(F.struct(F.col(symbol).alias("s"), F.col(n).alias("n"))).alias("counts"))
    key_type = dict(counts.dtypes)[key]

    def run(batches):
        for batch in batches:
            for k, rows in enumerate(batch.column(1).to_pylist()):
                whole = np.zeros(size, np.int64)
                for r in rows:
                    whole[r["s"]] += r["n"]
                lengths = prefix_codes.limited_lengths(whole, limit)
                used = np.flatnonzero(lengths)
                codes = prefix_codes.canonical(lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(used), pa.int64())), pa.array(used, pa.int32()), pa.array(lengths[used], pa.int32()), pa.array(codes[used], pa.int64())],
                    names=[key, "symbol", "bits", "code"],
                )

    return listed.mapInArrow(run, f"{key} {key_type}, symbol int, bits int, code long")


def lz77_tokens(images: DataFrame, band_rows: int) -> DataFrame:
    """``(image_id, band, kind, tokens, pixels)``: how many references of each kind bands hold."""
    id_type = dict(images.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for k, (width, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                rows = as_rows(raw.as_buffer(), width)
                if not len(rows):
                    continue
                w = width // 4
                flat = vp8l.packed(rows.reshape(len(rows), w, 4))
                for band, y in enumerate(range(0, len(rows), band_rows)):
                    tokens = vp8l.references(flat, y * w, min(len(rows), y + band_rows) * w, w)
                    for kind in range(3):
                        own = tokens[tokens[:, 0] == kind]
                        ids.append(k)
                        out.append((band, kind, len(own), int(own[:, 1].sum()) if kind == vp8l.COPY else len(own)))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["image_id", "band", "kind", "tokens", "pixels"]
            )

    return images.select("image_id", "row_bytes", "raw").mapInArrow(run, f"image_id {id_type}, band int, kind int, tokens long, pixels long")


def lzw_streams(images: DataFrame, kind: str) -> DataFrame:
    """``(image_id, n, stream)`` by GIF's or TIFF's LZW."""
    code = {"gif": lambda raw: lzw.gif_band(raw, 8, True, True)[0], "tiff": lzw.tiff_strip}[kind]
    made = each(images, lambda rows: code(rows.tobytes()))
    return made.select("image_id", F.col("file").alias("stream"))


def dithered(images: DataFrame, palette: np.ndarray, at_once: int = 8 << 20) -> DataFrame:
    """``(image_id, file, error)``: indices of R, G, B, A bytes under Floyd-Steinberg, in rows.

    Images of up to ``at_once`` bytes together are drawn side by side.
    """
    wide = palette.astype(np.int64) * 257
    id_type = dict(images.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64)
            taken = (np.cumsum(sizes) - sizes) // at_once
            starts = np.flatnonzero(np.append(True, taken[1:] != taken[:-1])) if len(taken) else taken
            for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                part = batch.slice(at, stop - at)
                files, errors, by_width = [None] * part.num_rows, [None] * part.num_rows, {}
                for k, (width, raw) in enumerate(zip(part.column(1).to_pylist(), part.column(2))):
                    try:
                        rows = need_rows(as_rows(raw.as_buffer() or b"", width))
                        pixels = rows.reshape(len(rows), -1, 4).astype(np.uint16) * np.uint16(257)
                    except ValueError as e:
                        errors[k] = str(e)
                    else:
                        by_width.setdefault(width, []).append((k, pixels))
                for own in by_width.values():
                    for (k, _), indices in zip(own, gif.dither_all([x for _, x in own], wide)):
                        files[k] = indices.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=["image_id", "file", "error"])

    return images.select("image_id", "row_bytes", "raw").mapInArrow(run, f"image_id {id_type}, file binary, error string")


def animations(frames: DataFrame, key: str, kind: str, width: int, height: int) -> DataFrame:
    """``(key, file)``: frames ``(frame, value, delay_ms)`` as an animation of flat squares.

    A key's frames are one file; ``kind`` is ``apng``, ``gif`` or ``webp``.
    """
    key_type = dict(frames.dtypes)[key]
    listed = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame", "value", "delay_ms"))).alias("frames"))

    def picture(value: int) -> np.ndarray:
        out = np.full((height, width, 4), 255, np.uint8)
        out[..., :3] = (value * 37 % 256, value * 91 % 256, value * 53 % 256)
        out[: height // 2, : value % width + 1, 0] = value % 251
        return out

    def make(rows) -> bytes:
        if kind == "apng":
            return png.encode_animation([png.Frame(picture(r["value"]), delay_ms=r["delay_ms"], dispose=r["value"] % 3, blend=r["value"] % 2) for r in rows])
        if kind == "webp":
            shown = {}  # a value's picture is one array
            for r in rows:
                if r["value"] not in shown:
                    shown[r["value"]] = np.ascontiguousarray(picture(r["value"])[..., [3, 0, 1, 2]])
            return webp.encode_animation([webp.Frame(shown[r["value"]], duration_ms=r["delay_ms"]) for r in rows])
        palette = tuple((v, v * 3 % 256, v * 7 % 256, 255) for v in range(16))
        made = [gif.Frame((np.indices((height, width)).sum(axis=0) * (r["value"] + 1) % 16).astype(np.uint8), palette, delay=r["delay_ms"] // 10) for r in rows]
        return gif.encode(made, width, height, 0)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([make(rows) for rows in part.column(1).to_pylist()], pa.binary())], names=[key, "file"])

    return listed.mapInArrow(run, f"{key} {key_type}, file binary")


def detached_bands(rows: DataFrame, options: png.Options = png.Options()) -> DataFrame:
    """``(stream, y0, y1, height, data, adler, n)`` of stretches ``(stream, y0, height, row_bytes, raw)``.

    Each stretch is encoded where it is, batch or stream, in any order.
    """

    def run(batches):
        for batch in batches:
            made = []
            for width, raw in zip(batch.column(3).to_pylist(), batch.column(4)):
                data = as_rows(raw.as_buffer(), width)
                made.append((len(data), png.encode_detached(data, png.layout_of("gray", width, max(1, len(data)), True), options)))
            y0 = np.asarray(batch.column(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(y0), pa.array(y0 + np.array([n for n, _ in made], np.int64)), batch.column(2), pa.array([b.data for _, b in made], pa.binary()),
                    pa.array([b.adler for _, b in made], pa.int64()), pa.array([b.length for _, b in made], pa.int64()),
                ],
                names=["stream", "y0", "y1", "height", "data", "adler", "n"],
            )

    chosen = rows.select("stream", F.col("y0").cast("long"), F.col("height").cast("long"), "row_bytes", "raw")
    return chosen.mapInArrow(run, "stream string, y0 long, y1 long, height long, data binary, adler long, n long")


def assembled(bands: DataFrame, row_bytes: int) -> DataFrame:
    """``(stream, file, error)``: complete streams as files; incomplete or overlapping ones as errors."""
    listed = bands.groupBy("stream").agg(F.max("height").alias("height"), F.sort_array(F.collect_list(F.struct("y0", "y1", "data", "adler", "n"))).alias("bands"))

    def run(batches):
        for batch in batches:
            files, errors = [], []
            for height, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = 0
                for p in parts:
                    if p["y0"] != at:
                        break
                    at = p["y1"]
                fits = at == height and parts[-1]["y1"] == height
                errors.append(None if fits else f"rows are missing or doubled at {at}")
                files.append(png.assemble(png.layout_of("gray", row_bytes, height, True), [(p["data"], p["adler"], p["n"]) for p in parts]) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=["stream", "file", "error"])

    return listed.mapInArrow(run, "stream string, file binary, error string")


def sniffed(files: DataFrame) -> DataFrame:
    """``(image_id, kind, parts)`` of files, by their bytes."""
    id_type = dict(files.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            kind, parts = zip(*(png.sniff(f) for f in batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kind, pa.string()), pa.array(parts, pa.int64())], names=["image_id", "kind", "parts"])

    return files.select("image_id", "file").mapInArrow(run, f"image_id {id_type}, kind string, parts long")
