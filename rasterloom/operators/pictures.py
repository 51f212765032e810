"""Pictures of any colour model as files and animations, one a row.

A picture is ``(image_id, width, height, model, raw)`` and, where it has one, a
``palette`` of R, G, B, A bytes.  ``raw`` holds its samples row by row, 16-bit
ones low byte first.  Models are gray, gray16, rgb, rgba (premultiplied), nrgba,
rgba64, nrgba64, cmyk and paletted.  What ``sources.images.decoded`` reads becomes
pictures by ``from_decoded``; ``files`` writes them in any of the formats.

A picture that cannot be encoded has a null file and its ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gif, jpeg, png, predictors, tiff, webp

CHANNELS = {"gray": 1, "gray16": 1, "rgb": 3, "rgba": 4, "nrgba": 4, "rgba64": 4, "nrgba64": 4, "cmyk": 4, "paletted": 1}
DEEP = ("gray16", "rgba64", "nrgba64")
_PICTURE = ("width", "height", "model", "raw", "palette")


def samples(width: int, height: int, model: str, raw: bytes) -> np.ndarray:
    """The samples ``(height, width, channels)`` of a picture."""
    if model not in CHANNELS:
        raise ValueError(f"unknown colour model {model!r}")
    if raw is None or not width or not height or width < 0 or height < 0:
        raise ValueError("an image has at least one pixel")
    x = np.frombuffer(raw, "<u2" if model in DEEP else np.uint8)
    if len(x) != width * height * CHANNELS[model]:
        raise ValueError(f"{len(x)} samples are no {width} x {height} pixels of {model}")
    return x.reshape(height, width, CHANNELS[model])


def colours(palette: bytes | None) -> tuple[tuple[int, ...], ...]:
    """A palette's R, G, B, A."""
    if not palette or len(palette) % 4 or len(palette) > 1024:
        raise ValueError("a palette has 1 to 256 colours")
    return tuple(map(tuple, np.frombuffer(palette, np.uint8).reshape(-1, 4).tolist()))


def straight(x: np.ndarray, model: str, palette=()) -> np.ndarray:
    """Any picture as R, G, B, A of 8 bits, or of 16 where its model has them; alpha not multiplied in."""
    full = 65535 if model in DEEP else 255
    if model == "paletted":
        if x.max() >= len(palette):
            raise ValueError("a pixel has no colour in the palette")
        return np.array(palette, np.uint8)[x[..., 0]]
    if model == "cmyk":
        ink = 255 - x.astype(np.int64)
        rgb = (ink[..., :3] * ink[..., 3:] + 127) // 255
    elif CHANNELS[model] == 1:
        rgb = np.repeat(x, 3, axis=2)
    elif model == "rgba":
        return predictors.straight_alpha(x)
    elif model == "rgba64":
        alpha = x[..., 3:].astype(np.int64)
        return np.concatenate([np.where(alpha > 0, np.minimum(x[..., :3].astype(np.int64) * 65535 // np.maximum(alpha, 1), 65535), 0), alpha], axis=2).astype(np.uint16)
    else:
        rgb = x[..., :3]
    alpha = x[..., 3:] if model in ("nrgba", "nrgba64") else np.full((*x.shape[:2], 1), full)
    return np.concatenate([rgb, alpha], axis=2).astype(np.uint16 if model in DEEP else np.uint8)


def eight(x: np.ndarray) -> np.ndarray:
    return (x >> 8).astype(np.uint8) if x.dtype.itemsize == 2 else x


def png_layout(x: np.ndarray, model: str, palette=()) -> tuple[np.ndarray, png.Layout]:
    """A picture's rows of bytes and layout: the palette or gray kept, alpha only where a pixel is not opaque."""
    h, w = x.shape[:2]
    if model == "paletted":
        if x.max() >= len(palette):
            raise ValueError("a pixel has no colour in the palette")
    elif CHANNELS[model] > 1:
        x = straight(x, model)
        model = "nrgba64" if model in DEEP else "nrgba"
    opaque = model not in ("nrgba", "nrgba64") or bool((x[..., 3] == (65535 if model in DEEP else 255)).all())
    layout = png.layout_of(model, w, h, opaque, palette)
    return png.scanlines(x, model, layout), layout


def png_file(x: np.ndarray, model: str, palette=(), options: png.Options = png.Options()) -> bytes:
    return png.encode(*png_layout(x, model, palette), options)


def tiff_file(x: np.ndarray, model: str, palette=(), **options) -> bytes:
    """Samples as they are: TIFF has all these models."""
    return tiff.encode(x, {"gray16": "gray", "rgba64": "rgba", "nrgba64": "nrgba"}.get(model, model), palette=palette, **options)


def gif_file(x: np.ndarray, model: str, palette=(), colours: int = 256, workers: int = 1, **drawing) -> bytes:
    """Palettes as they are; other models by a quantizer and a drawer (see ``gif.from_pixels``)."""
    if model == "paletted":
        return gif.encode([gif.Frame(x[..., 0], palette)], x.shape[1], x.shape[0], n_workers=workers)
    return gif.from_pixels(eight(straight(x, model))[..., :3], colours, n_workers=workers, **drawing)


def jpeg_file(x: np.ndarray, model: str, palette=(), quality: int = 75, subsample: bool = True, workers: int = 1) -> bytes:
    if model in ("gray", "gray16"):
        return jpeg.encode(eight(x), "gray", quality, workers, subsample)
    return jpeg.encode(eight(straight(x, model, palette))[..., :3], "rgb", quality, workers, subsample)


def argb(x: np.ndarray, model: str, palette=()) -> np.ndarray:
    return np.ascontiguousarray(eight(straight(x, model, palette))[..., [3, 0, 1, 2]])


def webp_file(x: np.ndarray, model: str, palette=(), workers: int = 1) -> bytes:
    return webp.encode(argb(x, model, palette), workers)


KINDS: dict[str, Callable[..., bytes]] = {"png": png_file, "tiff": tiff_file, "gif": gif_file, "jpeg": jpeg_file, "webp": webp_file}


def _with_palette(pictures: DataFrame) -> DataFrame:
    return pictures if "palette" in pictures.columns else pictures.withColumn("palette", F.lit(None).cast("binary"))


def files(pictures: DataFrame, kind: str, **options) -> DataFrame:
    """``(image_id, file, error)``: pictures as png, tiff, gif, jpeg or webp files; ``options`` are those of the kind."""
    make = KINDS[kind]
    rows = _with_palette(pictures).select("image_id", *_PICTURE)
    id_type = dict(rows.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for width, height, model, raw, palette in zip(*(part.column(i).to_pylist() for i in range(1, 6))):
                    try:
                        x = samples(width, height, model, raw)
                        out.append((make(x, model, colours(palette) if model == "paletted" else (), **options), None))
                    except ValueError as e:
                        out.append((None, str(e)))
                made, errors = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["image_id", "file", "error"])

    return rows.mapInArrow(run, f"image_id {id_type}, file binary, error string")


def inferred(pictures: DataFrame) -> DataFrame:
    """``(image_id, colour, depth, opaque, row_bytes, error)``: the PNG layout that a picture's pixels lead to."""
    rows = _with_palette(pictures).select("image_id", *_PICTURE)
    id_type = dict(rows.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            out = []
            for width, height, model, raw, palette in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                try:
                    layout = png_layout(samples(width, height, model, raw), model, table := colours(palette) if model == "paletted" else ())[1]
                    out.append((layout.colour, layout.depth, layout.colour != png.RGBA and all(c[3] == 255 for c in table), layout.row_bytes, None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            columns = zip(*out) if out else [()] * 5
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["image_id", "colour", "depth", "opaque", "row_bytes", "error"])

    return rows.mapInArrow(run, f"image_id {id_type}, colour int, depth int, opaque boolean, row_bytes long, error string")


def from_decoded(decoded: DataFrame) -> DataFrame:
    """Pictures of what Spark's image reader gives, whose samples stand B, G, R and A; files with an error have no model."""
    rows = decoded.select("image_id", "width", "height", "channels", "raw")
    id_type = dict(rows.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            models, raws = [], []
            for width, height, channels, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if raw is None or channels not in (1, 3, 4):
                    models.append(None)
                    raws.append(None)
                    continue
                x = np.frombuffer(raw, np.uint8).reshape(height, width, channels)
                models.append({1: "gray", 3: "rgb", 4: "nrgba"}[channels])
                raws.append((x if channels == 1 else x[..., [2, 1, 0, 3][:channels]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(models, pa.string()), pa.array(raws, pa.binary())], names=["image_id", "width", "height", "model", "raw"])

    return rows.mapInArrow(run, f"image_id {id_type}, width int, height int, model string, raw binary")


FRAME_FIELDS = {"x": "int", "y": "int", "delay_ms": "long", "dispose": "int", "blend": "int"}


def animations(frames: DataFrame, key: str, kind: str, loops: int = 0, width: int = 0, height: int = 0) -> DataFrame:
    """``(key, file, error)``: a key's frames in the order of ``frame`` as one apng, gif or webp file.

    A frame is a picture with ``frame`` and, where they are not 0, ``x``, ``y``,
    ``delay_ms``, ``dispose`` and ``blend`` (PNG's codes).  The canvas of a GIF or
    WebP is as large as its frames reach unless a size is given.
    """
    rows = _with_palette(frames)
    absent = [F.lit(0).cast(t).alias(c) for c, t in FRAME_FIELDS.items() if c not in rows.columns]
    rows = rows.select(key, "frame", *_PICTURE, *(F.col(c).cast(t) for c, t in FRAME_FIELDS.items() if c in rows.columns), *absent)
    # an animation is one file and fits a task by nature
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame", *_PICTURE, *FRAME_FIELDS))).alias("frames"))
    key_type = dict(rows.dtypes)[key]

    def picture(r) -> tuple:
        return samples(r["width"], r["height"], r["model"], r["raw"]), r["model"], colours(r["palette"]) if r["model"] == "paletted" else ()

    def make(rows) -> bytes:
        if kind == "webp":
            made = [webp.Frame(argb(*picture(r)), r["x"], r["y"], r["delay_ms"], blend=r["blend"] == 1, dispose=r["dispose"] == 1) for r in rows]
            return webp.encode_animation(made, width, height, loops)
        if kind == "gif":
            if any(r["model"] != "paletted" for r in rows):
                raise ValueError("the frames of a GIF have palettes")
            made = [gif.Frame(x[..., 0], table, x=r["x"], y=r["y"], delay=r["delay_ms"] // 10, disposal=r["dispose"]) for r in rows for x, _, table in [picture(r)]]
            return gif.encode(made, width or max(r["x"] + r["width"] for r in rows), height or max(r["y"] + r["height"] for r in rows), loops)
        made = []
        for r in rows:
            x, model, table = picture(r)
            if model not in ("gray", "gray16", "paletted"):
                x, model = straight(x, model), "nrgba64" if model in DEEP else "nrgba"
            made.append(png.Frame(x, model, palette=table, x=r["x"], y=r["y"], delay_ms=r["delay_ms"], dispose=r["dispose"], blend=r["blend"]))
        return png.encode_animation(made, loops)

    def run(batches):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                try:
                    out.append((make(rows), None))
                except ValueError as e:
                    out.append((None, str(e)))
            made, errors = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=[key, "file", "error"])

    return listed.mapInArrow(run, f"{key} {key_type}, file binary, error string")
