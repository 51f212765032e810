"""Where images come from: files, byte columns, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content, digest)`` of files, with their SHA-256."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "content", F.sha2("content", 256).alias("digest"))


def checked(found: DataFrame, sums: DataFrame) -> DataFrame:
    """Files with a ``verdict``: known, changed or unknown, by a list ``(name, known)`` of checksums."""
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = named.join(sums, "name", "left")
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("known") == F.col("digest"), "known").otherwise("changed")
    return joined.withColumn("verdict", verdict).drop("known")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Images ``(image_id, height, width, channels, row_bytes, raw, error)`` by Spark's reader; blue comes first.

    A file that cannot be decoded is a row of nulls with its ``error``.
    """
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    good = F.col("height") >= 0
    values = {"height": F.col("height"), "width": F.col("width"), "channels": F.col("nChannels"), "row_bytes": F.col("width") * F.col("nChannels"), "raw": F.col("data")}
    return rows.select(F.col("origin").alias("image_id"), *(F.when(good, v).alias(c) for c, v in values.items()), F.when(~good, "cannot be decoded").alias("error"))


def inferred(images: DataFrame) -> DataFrame:
    """Images with ``opaque`` and the PNG layout ``(colour, depth)`` it leads to.

    ``images`` has ``model`` and ``raw`` (8-bit samples, alpha last of four).
    """
    alphas = F.expr("transform(sequence(0, octet_length(raw) div 4 - 1), k -> substring(raw, 4 * k + 4, 1))")
    four = F.col("model").isin("rgba", "nrgba")
    opaque = F.when(four & (F.octet_length("raw") > 0), F.forall(alphas, lambda a: a == F.lit(b"\xff"))).otherwise(F.lit(True))
    colour = F.when(F.col("model") == "paletted", 3).when(F.col("model") == "gray", 0).when(F.col("opaque"), 2).otherwise(6)
    return images.withColumn("opaque", opaque).withColumn("colour", colour).withColumn("depth", F.lit(8))


def synthetic(spark: SparkSession, kind: str, width: int, height: int, seed: int = 1, image_id: int = 0) -> DataFrame:
    """``(image_id, y, x, r, g, b)`` of a made image: page, ui, gradient, flat or noise.

    Every pixel is an expression of its place, so any part can be made anywhere.
    """
    x, y = F.col("x"), F.col("y")
    noise = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), y, x), F.lit(256)).cast("int")
    line = (F.pmod(y, F.lit(24)) > 6) & (F.pmod(y, F.lit(24)) < 18) & (x > width / 12) & (x < width - width / 12)
    glyph = F.pmod(F.xxhash64(F.lit(seed), F.floor(y / 24), F.floor(x / 5)), F.lit(10)) < 6
    ink = F.when(line & glyph & (F.pmod(noise(0), F.lit(4)) > 0), 20).otherwise(255)
    box = F.pmod(F.floor(x / 160) + F.floor(y / 90), F.lit(4))
    rgb = {
        "page": [ink] * 3,
        "ui": [F.when(box == 0, v[0]).when(box == 1, v[1]).when(box == 2, v[2]).otherwise(v[3]) for v in ((240, 30, 66, 255), (240, 60, 133, 255), (245, 90, 244, 255))],
        "gradient": [F.least(F.lit(255), F.floor(x * 255 / max(1, width)) + F.pmod(noise(1), F.lit(4))), F.floor(y * 255 / max(1, height)), F.floor((x + y) * 255 / max(1, width + height))],
        "flat": [F.lit(200), F.lit(180), F.lit(40)],
        "noise": [noise(1), noise(2), noise(3)],
    }[kind]
    pixels = spark.range(width * height).select(F.expr(f"id div {width}").cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return pixels.select(F.lit(image_id).alias("image_id"), "y", "x", *(c.cast("int").alias(n) for c, n in zip(rgb, "rgb")))


def gathered(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Pixels ``(image_id, y, x, channels)`` as rows of bytes ``(image_id, y, raw)``."""
    byte = lambda c: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2, "0"))
    cells = pixels.select("image_id", "y", "x", F.concat(*(byte(c) for c in channels)).alias("v"))
    return cells.groupBy("image_id", "y").agg(F.expr("listagg(v) within group (order by x)").alias("raw"))


def opened(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Rows of bytes ``(image_id, y, raw)`` as pixels."""
    n = len(channels)
    one = lambda k: F.conv(F.hex(F.expr(f"substring(raw, {n} * x + {k + 1}, 1)")), 16, 10).cast("int")
    return rows.select("image_id", "y", "raw", F.explode(F.sequence(F.lit(0), F.expr(f"cast(octet_length(raw) div {n} - 1 as int)"))).alias("x")).select("image_id", "y", "x", *(one(k).alias(c) for k, c in enumerate(channels)))


def translated(pixels: DataFrame) -> DataFrame:
    """Pixels moved so that each image begins at (0, 0)."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id")
    return pixels.withColumn("x", F.col("x") - F.min("x").over(w)).withColumn("y", F.col("y") - F.min("y").over(w))
