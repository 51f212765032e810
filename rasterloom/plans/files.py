"""Queries that end in files and streams; checked by decoding, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import png
from ..operators import encode, images, pictures
from ..streaming import bands_stream
from .common import Queries, table, text_images

Q = Queries()


def _digest(files, key="image_id"):
    """Sizes and hashes in place of whole files."""
    return files.select(F.col(key).alias("doc_id"), F.octet_length("file").alias("n_bytes"), F.md5("file").alias("digest"))


@Q.add()
def png_file(spark, folder):
    return _digest(encode.png_files(text_images(spark, folder).filter("height > 0")))


@Q.add()
def png_fast_file(spark, folder):
    return _digest(encode.png_files(text_images(spark, folder).filter("height > 0"), png.Options(fast=True)))


@Q.add()
def png_rows_file(spark, folder):
    """Files from single rows, a task a band, with halos."""
    whole = text_images(spark, folder).filter("height > 0")
    heights = whole.select("image_id", F.col("height").cast("long").alias("height"))
    return _digest(encode.png_bands(images.scanlines(whole), heights, 64, 128))


@Q.add()
def deflate_bands(spark, folder):
    made = encode.band_streams(text_images(spark, folder), png.Options(workers=4, band_bytes=4096, band_rows=16))
    return made.select(F.col("image_id").alias("doc_id"), "band", "y0", "y1", F.octet_length("data").alias("n_bytes"), "adler", "n")


@Q.add()
def lzw_gif(spark, folder):
    made = encode.lzw_streams(text_images(spark, folder), "gif")
    return made.select(F.col("image_id").alias("doc_id"), F.octet_length("stream").alias("n_bytes"), F.md5("stream").alias("digest"))


@Q.add()
def lzw_tiff(spark, folder):
    made = encode.lzw_streams(text_images(spark, folder), "tiff")
    return made.select(F.col("image_id").alias("doc_id"), F.octet_length("stream").alias("n_bytes"), F.md5("stream").alias("digest"))


@Q.add()
def huffman_lengths(spark, folder):
    counts = images.histogram(text_images(spark, folder), 4)
    return encode.huffman_lengths(counts, "alphabet", "symbol", "n", 256, 15)


@Q.add()
def dither_fs(spark, folder):
    grays = np.array([[v, v, v, 255] for v in range(0, 256, 17)])
    small = text_images(spark, folder).filter("height > 0")
    return _digest(encode.dithered(small, grays))


@Q.add()
def lz77_tokens(spark, folder):
    return encode.lz77_tokens(text_images(spark, folder), 16).withColumnRenamed("image_id", "doc_id")


@Q.add()
def jpeg_file(spark, folder):
    return _digest(encode.jpeg_files(text_images(spark, folder, 96).filter("height > 0")))


@Q.add()
def tiff_file(spark, folder):
    return _digest(encode.tiff_files(text_images(spark, folder).filter("height > 0"), "deflate", True))


@Q.add()
def gif_file(spark, folder):
    return _digest(encode.gif_files(text_images(spark, folder).filter("height > 0")))


@Q.add()
def webp_file(spark, folder):
    return _digest(encode.webp_files(text_images(spark, folder).filter("height > 0")))


def _frames(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame"), (F.col("event_id") % 64).cast("int").alias("value"), (F.col("event_id") % 90 + 10).alias("delay_ms"))


@Q.add()
def apng_file(spark, folder):
    return _digest(encode.animations(_frames(spark, folder), "user_id", "apng", 24, 16), "user_id").withColumnRenamed("doc_id", "user_id")


@Q.add()
def gif_animation(spark, folder):
    return _digest(encode.animations(_frames(spark, folder), "user_id", "gif", 24, 16), "user_id").withColumnRenamed("doc_id", "user_id")


@Q.add()
def webp_animation(spark, folder):
    return _digest(encode.animations(_frames(spark, folder), "user_id", "webp", 24, 16), "user_id").withColumnRenamed("doc_id", "user_id")


@Q.add()
def png_stream(spark, folder):
    """Bands that come in any order, held back until the rows before them are there."""
    made = encode.band_streams(text_images(spark, folder), png.Options(workers=4, band_bytes=4096, band_rows=16))
    rows = made.withColumn("height", F.max("y1").over(Window.partitionBy("image_id")))
    done = bands_stream.reorder_batch(rows.select(F.col("image_id").cast("string").alias("stream"), "y0", "y1", "height", F.col("data")))
    return done.select("stream", "seq", "y0", "y1", "error")


@Q.add()
def png_detached_file(spark, folder):
    """Files of stretches of 24 rows, each encoded without the others."""
    whole = text_images(spark, folder).filter("height > 0")
    cut = whole.select(F.col("image_id").cast("string").alias("stream"), "height", "row_bytes", "raw", F.explode(F.expr("sequence(0, height - 1, 24)")).alias("y0"))
    stretches = cut.select("stream", "height", "row_bytes", "y0", F.expr("substring(raw, y0 * row_bytes + 1, least(24, height - y0) * row_bytes)").alias("raw"))
    files = encode.assembled(encode.detached_bands(stretches), 64)
    return files.select("stream", F.octet_length("file").alias("n_bytes"), F.md5("file").alias("digest"), "error")


@Q.add()
def container_sniff(spark, folder):
    """What files are, by their first bytes, and into how many parts they are cut."""
    source = text_images(spark, folder).filter("height > 0")
    made = encode.png_files(source).select("image_id", "file").unionByName(encode.gif_files(source).select("image_id", "file"))
    made = made.unionByName(encode.jpeg_files(text_images(spark, folder, 96).filter("height > 0"), workers=8).select("image_id", "file"))
    return encode.sniffed(made).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("most_parts"))


_MODELS = ("gray", "gray16", "rgb", "rgba", "nrgba", "rgba64", "nrgba64", "cmyk", "paletted")


def _pictures(spark, folder):
    """Documents as pictures 16 pixels wide, of all colour models in turn; alphas are what the bytes say."""
    docs = text_images(spark, folder).filter("height > 0")
    at = F.pmod(F.col("image_id"), F.lit(len(_MODELS))).cast("int") + 1
    size = F.element_at(F.array(*(F.lit(pictures.CHANNELS[m] * (2 if m in pictures.DEEP else 1)) for m in _MODELS)), at)
    chosen = docs.select("image_id", F.element_at(F.array(*map(F.lit, _MODELS)), at).alias("model"), size.alias("size"), "raw")
    rows = chosen.withColumn("height", F.expr("octet_length(raw) div (16 * size)").cast("int")).filter("height > 0")
    palette = b"".join(bytes((v, 3 * v % 256, 7 * v % 256, 255)) for v in range(256))
    return rows.select("image_id", F.lit(16).alias("width"), "height", "model", F.expr("substring(raw, 1, 16 * height * size)").alias("raw"), F.lit(palette).alias("palette"))


@Q.add()
def picture_layouts(spark, folder):
    return pictures.inferred(_pictures(spark, folder)).withColumnRenamed("image_id", "doc_id")


def _picture_files(kind, **options):
    def run(spark, folder):
        return _digest(pictures.files(_pictures(spark, folder), kind, **options))

    run.__name__ = f"picture_{kind}"
    return run


for _kind, _options in (("png", {}), ("tiff", {"compression": "lzw", "predictor": True}), ("jpeg", {}), ("webp", {})):
    Q.add()(_picture_files(_kind, **_options))


@Q.add()
def picture_animation(spark, folder):
    """Pictures of one size as the frames of animations, sixteen to a file."""
    rows = _pictures(spark, folder).filter("model in ('rgb', 'nrgba')").withColumn("raw", F.expr("substring(raw, 1, 16 * if(model = 'rgb', 3, 4))")).withColumn("height", F.lit(1))
    frames = rows.withColumn("file_id", F.expr("image_id div 144")).withColumn("frame", F.col("image_id")).withColumn("delay_ms", F.lit(40))
    return _digest(pictures.animations(frames, "file_id", "apng").withColumnRenamed("file_id", "image_id"))
