"""Images as rows of a DataFrame, and what is done to each of them.

An image is ``(image_id, height, row_bytes, raw)``: its rows of bytes, one
after the other.  Work within an image is array code on Arrow batches, so no
row is shuffled to see its neighbour; images are what is dealt to executors.
For images too large for one task, rows or bands are the unit instead (see
``bands``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predictors


def from_bytes(df: DataFrame, id_col: str, raw, row_bytes: int = 64) -> DataFrame:
    """Byte strings as images of a fixed row length; the last row is filled up with zeros."""
    rows = df.select(F.col(id_col).alias("image_id"), raw.alias("raw"))
    height = F.ceil(F.octet_length("raw") / row_bytes).cast("int")
    return rows.select("image_id", height.alias("height"), F.lit(row_bytes).alias("row_bytes"), F.rpad("raw", height * row_bytes, F.lit(b"\x00")).alias("raw"))


def from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 64) -> DataFrame:
    """Texts as images: their UTF-8 bytes in rows."""
    return from_bytes(df, id_col, C.utf8(F.col(text_col)), row_bytes)


def as_rows(raw: bytes, row_bytes: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, row_bytes)


def per_image(images: DataFrame, make: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Array code on every image; each may give any number of rows.

    ``make`` takes rows of bytes ``(height, row_bytes)`` and returns equally long
    columns; the image's id is put before them.
    """
    id_type = dict(images.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for width, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                got = make(as_rows(raw.as_buffer(), width))
                found.append(got)
                counts.append(len(next(iter(got.values()))))
            if not found:
                continue
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
            names = list(found[0])
            merged = [pa.array(np.concatenate([f[k] for f in found])) if isinstance(found[0][k], np.ndarray) else pa.array([x for f in found for x in f[k]]) for k in names]
            yield pa.RecordBatch.from_arrays([ids, *merged], names=["image_id", *names])

    return images.select("image_id", "row_bytes", "raw").mapInArrow(run, f"image_id {id_type}, {schema}")


def scanlines(images: DataFrame) -> DataFrame:
    """``(image_id, y, raw)``, one row of bytes a row; on the JVM."""
    at = F.explode(F.sequence(F.lit(0), F.col("height") - 1))
    rows = images.filter("height > 0").select("image_id", "row_bytes", "raw", at.alias("y"))
    return rows.select("image_id", "y", F.expr("substring(raw, y * row_bytes + 1, row_bytes)").alias("raw"))


def row_filters(images: DataFrame, bpp: int = 1, with_residuals: bool = False) -> DataFrame:
    """``(image_id, y, filter, cost)`` of the row filter with the least cost."""

    def make(rows):
        kinds, costs, residuals = predictors.select_filters(rows, bpp)
        out = {"y": np.arange(len(rows), dtype=np.int32), "filter": kinds.astype(np.int32), "cost": costs}
        if with_residuals:
            out["residual"] = [r.tobytes() for r in residuals]
        return out

    return per_image(images, make, "y int, filter int, cost long" + (", residual binary" if with_residuals else ""))


def row_filters_halo(rows: DataFrame, bpp: int = 1) -> DataFrame:
    """The same from single rows ``(image_id, y, raw)`` of images too large for a task.

    Each row gets the one above it from a window; rows are then filtered by
    themselves.
    """
    from pyspark.sql import Window

    above = F.lag("raw").over(Window.partitionBy("image_id").orderBy("y"))
    id_type = dict(rows.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            out = []
            for raw, up in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one = np.frombuffer(raw, np.uint8)[None]
                kinds, costs, _ = predictors.select_filters(one, bpp, None if up is None else np.frombuffer(up, np.uint8))
                out.append((int(kinds[0]), int(costs[0])))
            kind, cost = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kind, pa.int32()), pa.array(cost, pa.int64())], names=["image_id", "y", "filter", "cost"])

    return rows.select("image_id", "y", "raw", above.alias("up")).mapInArrow(run, f"image_id {id_type}, y int, filter int, cost long")


def residual_sums(images: DataFrame, kind: int, bpp: int = 1) -> DataFrame:
    """``(image_id, total, n)``: the sum of all bytes under one filter, and their number."""

    def make(rows):
        r = predictors.filtered(rows, bpp, kind)
        return {"total": np.array([r.sum(dtype=np.int64)]), "n": np.array([r.size], np.int64)}

    return per_image(images, make, "total long, n long")


def filter_costs(images: DataFrame, bpp: int = 1) -> DataFrame:
    """``(image_id, y, none, sub, up, average, paeth)``: each filter's cost."""
    names = ("none", "sub", "up", "average", "paeth")

    def make(rows):
        out = {"y": np.arange(len(rows), dtype=np.int32)}
        for kind, name in enumerate(names):
            out[name] = predictors.signed_cost(predictors.filtered(rows, bpp, kind)).sum(axis=1, dtype=np.int64)
        return out

    return per_image(images, make, "y int, " + ", ".join(f"{n} long" for n in names))


def detached_first_rows(images: DataFrame, band_rows: int = 16, bpp: int = 1) -> DataFrame:
    """``(image_id, band, filter, cost)`` of the first row of each band made on its own."""

    def make(rows):
        firsts = rows[::band_rows]
        got = [predictors.select_filters(r[None], bpp, None, True) for r in firsts]
        return {
            "band": np.arange(len(firsts), dtype=np.int32),
            "filter": np.array([int(k[0]) for k, _, _ in got], np.int32),
            "cost": np.array([int(c[0]) for _, c, _ in got], np.int64),
        }

    return per_image(images, make, "band int, filter int, cost long")


def horizontal_sums(images: DataFrame, samples: int, wide: bool = False) -> DataFrame:
    """``(image_id, total)`` of TIFF's horizontal differences, in bytes or little-endian words."""

    def make(rows):
        x = rows.view("<u2") if wide else rows
        return {"total": np.array([predictors.horizontal(x, samples).sum(dtype=np.int64)])}

    return per_image(images, make, "total long")


def green_subtracted(images: DataFrame) -> DataFrame:
    """``(image_id, red, green, blue)``: sums after red and blue less green; bytes are A, R, G, B."""

    def make(rows):
        x = predictors.subtract_green(rows.reshape(-1, 4)).sum(axis=0, dtype=np.int64)
        return {"red": x[1:2], "green": x[2:3], "blue": x[3:4]}

    return per_image(images, make, "red long, green long, blue long")


def tile_modes(images: DataFrame) -> DataFrame:
    """``(image_id, tx, ty, mode, cost)``: the predictor of each 16 x 16 tile; bytes are A, R, G, B."""

    def make(rows):
        if not len(rows):
            return {k: np.zeros(0, t) for k, t in (("tx", np.int32), ("ty", np.int32), ("mode", np.int32), ("cost", np.int64))}
        modes, costs, _ = predictors.tile_modes(rows.reshape(len(rows), -1, 4))
        ty, tx = np.indices(modes.shape)
        return {"tx": tx.ravel().astype(np.int32), "ty": ty.ravel().astype(np.int32), "mode": modes.ravel().astype(np.int32), "cost": costs.ravel()}

    return per_image(images, make, "tx int, ty int, mode int, cost long")


def tile_residuals(images: DataFrame) -> DataFrame:
    """``(image_id, tx, ty, total)``: residual bytes under each tile's predictor, summed; bytes are A, R, G, B."""

    def make(rows):
        if not len(rows):
            return {k: np.zeros(0, t) for k, t in (("tx", np.int32), ("ty", np.int32), ("total", np.int64))}
        modes, _, chosen = predictors.tile_modes(rows.reshape(len(rows), -1, 4))
        th, tw = modes.shape
        grid = np.zeros((th * predictors.TILE, tw * predictors.TILE), np.int64)
        grid[:chosen.shape[0], :chosen.shape[1]] = chosen.sum(axis=2, dtype=np.int64)
        ty, tx = np.indices(modes.shape)
        total = grid.reshape(th, predictors.TILE, tw, predictors.TILE).sum(axis=(1, 3))
        return {"tx": tx.ravel().astype(np.int32), "ty": ty.ravel().astype(np.int32), "total": total.ravel()}

    return per_image(images, make, "tx int, ty int, total long")


def straight_sums(images: DataFrame) -> DataFrame:
    """``(image_id, red, green, blue)``: sums of straight colours of premultiplied R, G, B, A bytes."""

    def make(rows):
        x = predictors.straight_alpha(rows.reshape(-1, 4)).sum(axis=0, dtype=np.int64)
        return {"red": x[:1], "green": x[1:2], "blue": x[2:3]}

    return per_image(images, make, "red long, green long, blue long")


def packed_indices(images: DataFrame, depth: int) -> DataFrame:
    """``(image_id, y, packed)``: bytes as indices (modulo their number), packed from the high bits."""
    from ..functions.png import pack_indices

    def make(rows):
        packed = pack_indices(rows % (1 << depth), depth)
        return {"y": np.arange(len(rows), dtype=np.int32), "packed": [r.tobytes() for r in packed]}

    return per_image(images, make, "y int, packed binary")


def swapped(images: DataFrame) -> DataFrame:
    """``(image_id, raw)`` with the bytes of each 16-bit sample swapped."""
    return per_image(images, lambda rows: {"raw": [np.ascontiguousarray(rows).reshape(-1).view("<u2").byteswap().tobytes()]}, "raw binary")


def match_runs(images: DataFrame, distance: int) -> DataFrame:
    """``(image_id, runs, longest, covered)``: stretches equal to the bytes ``distance`` before."""

    def make(rows):
        x = rows.reshape(-1)
        same = np.concatenate([[False], x[distance:] == x[:-distance], [False]]) if len(x) > distance else np.zeros(2, bool)
        edges = np.flatnonzero(same[1:] != same[:-1])
        n = edges[1::2] - edges[::2]
        return {"runs": np.array([len(n)], np.int64), "longest": np.array([n.max(initial=0)], np.int64), "covered": np.array([n.sum()], np.int64)}

    return per_image(images, make, "runs long, longest long, covered long")


def adler(images: DataFrame) -> DataFrame:
    """``(image_id, n, adler)`` of the rows' bytes."""
    import zlib

    return per_image(images, lambda rows: {"n": np.array([rows.size], np.int64), "adler": np.array([zlib.adler32(rows.tobytes())], np.int64)}, "n long, adler long")


def histogram(images: DataFrame, period: int = 1) -> DataFrame:
    """``(alphabet, symbol, n)`` over all images; a byte's alphabet is its place modulo ``period``.

    Counts are made per batch before they are shuffled: at most 256 rows an
    alphabet and batch.
    """

    def run(batches):
        for batch in batches:
            total = np.zeros((period, 256), np.int64)
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), np.uint8)
                for k in range(period):
                    total[k] += np.bincount(x[k::period], minlength=256)
            alphabet, symbol = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(alphabet.astype(np.int32)), pa.array(symbol.astype(np.int32)), pa.array(total[alphabet, symbol])], names=["alphabet", "symbol", "n"])

    counts = images.select("raw").mapInArrow(run, "alphabet int, symbol int, n long")
    return counts.groupBy("alphabet", "symbol").agg(F.sum("n").alias("n"))


def nearest_colours(pixels: DataFrame, channels: list[str], palette: np.ndarray) -> DataFrame:
    """The rows with ``nearest``: the palette index of each row's 8-bit colour, the first of equals.

    The palette, at most 256 colours of 16-bit channels, goes with the code; no join is needed.
    """
    from ..functions.gif import nearest

    at = [pixels.columns.index(c) for c in channels]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                wide = np.stack([np.asarray(part.column(k)).astype(np.int64) * 257 for k in at], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest(wide, palette).astype(np.int32))], names=[*part.schema.names, "nearest"])

    types = ", ".join(f"`{c}` {t}" for c, t in pixels.dtypes)
    return pixels.mapInArrow(run, f"{types}, nearest int")
