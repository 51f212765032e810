"""Scalar functions as Spark column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; a null is empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def row_bytes(width: Column, channels: Column, depth: Column) -> Column:
    """Bytes of a row of pixels."""
    return F.expr("0").cast("long") + F.floor((width.cast("long") * channels * depth + 7) / 8)


def palette_depth(colours: Column) -> Column:
    """Bits of an index into a palette."""
    return F.when(colours <= 2, 1).when(colours <= 4, 2).when(colours <= 16, 4).otherwise(8)


def table_bits(colours: Column) -> Column:
    """n for a colour table of 2 ** (n + 1) entries."""
    return F.when(colours <= 2, 0).otherwise(F.length(F.bin((colours - 1).cast("long"))) - 1)


def signed_cost(byte: Column) -> Column:
    """Magnitude of a byte read as a signed number."""
    return F.least(byte, 256 - byte)


def wrap(value: Column, size: int = 256) -> Column:
    """A value modulo the size of its type."""
    return F.pmod(value, F.lit(size))


def magnitude_bits(value: Column) -> Column:
    """Bits of a magnitude; 0 has none."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value).cast("long"))))


def prefix_symbol(value: Column) -> Column:
    """VP8L's prefix symbol of a length or distance code from 1."""
    v = (value - 1).cast("long")
    high = F.length(F.bin(v)) - 1
    second = F.expr("0").cast("long") + F.floor(v / F.pow(F.lit(2.0), (high - 1).cast("double"))) % 2
    return F.when(value < 5, value - 1).otherwise(2 * high + second).cast("int")


def prefix_extra_bits(value: Column) -> Column:
    return F.when(value < 5, 0).otherwise(F.length(F.bin((value - 1).cast("long"))) - 2).cast("int")


def cache_slot(argb: Column, bits: int = 10) -> Column:
    """Colour-cache slot of a packed pixel; the product stays below 2**63."""
    product = argb.cast("long") * F.lit(0x1E35A7BD).cast("long")
    return F.shiftright(product.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 32 - bits).cast("int")


def chunk_size(n: Column) -> Column:
    """Bytes of a RIFF chunk with n bytes of data."""
    return 8 + n + n % 2


def delay_numerator(ns: Column) -> Column:
    n = F.greatest(ns, F.lit(0).cast("long"))
    return F.when(n < 65536 * 1_000_000, F.expr("1").cast("long") * F.floor(n / 1_000_000)).when(n < 65536 * 10_000_000, F.floor(n / 10_000_000)).otherwise(F.least(F.floor(n / 1_000_000_000), F.lit(65535)))


def delay_denominator(ns: Column) -> Column:
    return F.when(ns < 65536 * 1_000_000, 1000).when(ns < 65536 * 10_000_000, 100).otherwise(1)


def quality_scale(quality: Column) -> Column:
    return F.when(quality < 50, F.floor(5000 / quality)).otherwise(200 - 2 * quality).cast("int")


def pair_hash(first: Column, second: Column, bits: int = 16) -> Column:
    """Bucket of two packed pixels; the larger factor is multiplied in halves, as its product passes 2**63."""
    low = lambda c, n: c.cast("long").bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    factor = F.lit(0x9E3779B1).cast("long")
    high = F.shiftleft(low(F.shiftright(second.cast("long"), 16) * factor, 16), 16)
    one = low(low(first, 32) * F.lit(0x1E35A7BD).cast("long"), 32)
    two = low(low(second, 16) * factor + high, 32)
    return F.shiftright(one.bitwiseXOR(two), 32 - bits).cast("int")


def lzw_bucket(code: Column, byte: Column, bits: int = 13) -> Column:
    """Bucket of an LZW phrase: a code of twelve bits and the byte after it."""
    key = F.shiftleft(code.cast("long"), 8).bitwiseOR(byte.cast("long"))
    return F.shiftright(key, 12).bitwiseXOR(key).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def scaled_entry(base: Column, quality: Column) -> Column:
    """A quantisation table's entry at a quality."""
    return F.greatest(F.least(F.floor((base * quality_scale(quality) + 50) / 100), F.lit(255)), F.lit(1)).cast("int")


def half_away(a: Column, b: Column) -> Column:
    """a / b rounded half away from zero, in integers."""
    return (F.signum(a.cast("double")) * F.floor((F.abs(a) + F.floor(b / 2)) / b)).cast("long")


def slug(text: Column) -> Column:
    """Lower case, other characters as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ratio(a: Column, b: Column) -> Column:
    """A ratio; null where it has no value."""
    return F.try_divide(a, b)


def band_cuts(height: str, least: str, align: str, workers: str, per_worker: str) -> Column:
    """First rows of bands as an array, from the names or values of the five numbers."""
    n = f"if({workers} <= 1, 1, greatest(1, least({workers} * {per_worker}, {height} div greatest(1, {least}, {align}))))"
    return F.expr(
        f"array_sort(array_distinct(filter(transform(sequence(0, {n} - 1), "
        f"i -> if(i = 0, 0, ((i * {height}) div ({n})) div {align} * {align})), c -> c = 0 or (c > 0 and c < {height}))))"
    )


def adler_fold(parts: Column) -> Column:
    """Adler-32 of stretches joined: an ordered array of structs ``(a, b, n)``."""
    base = 65521
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s, p):
        return F.struct(
            F.pmod(s["a"] + p["a"] - 1, F.lit(base)).cast("long").alias("a"),
            F.pmod(s["b"] + p["b"] + p["n"] % base * (s["a"] - 1), F.lit(base)).cast("long").alias("b"),
        )

    return F.aggregate(parts, start, step, lambda s: s["b"] * 65536 + s["a"])


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)


def chroma_blue(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(-11056 * r - 21712 * g + 32768 * b + 32768, 16) + 128))


def chroma_red(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(32768 * r - 27440 * g - 5328 * b + 32768, 16) + 128))


def restart_rows(mcu_rows: str, mcus: str, workers: int, least: int = 4, per_worker: int = 2) -> Column:
    """MCU rows of a restart interval, from the names of an image's MCU rows and MCUs a row."""
    n = "1" if workers <= 1 else f"greatest(1, least({workers * per_worker}, {mcu_rows} div {least}))"
    k = f"(({mcu_rows} + {n} - 1) div {n})"
    return F.expr(f"if({k} * {mcus} > 65535, 65535 div {mcus}, {k})")
