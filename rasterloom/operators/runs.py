"""Runs, codes, block coefficients, differences: windows and array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.blocks import BASIS, fixed_dct


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``(key, value, first, n)``: runs of equal values, ``first`` counted from 1.

    One window: a run begins where the value differs from the one before it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    marked = df.select(*key, value, F.row_number().over(w).alias("_i"), new.alias("_new"))
    numbered = marked.withColumn("_run", F.sum("_new").over(Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, value, "_run").agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("n")).drop("_run")


def repeat_symbols(runs: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, s16, s17, s18, literals)``: how runs of code lengths are sent."""
    n, zero = F.col("n"), F.col(value) == 0
    left = n % 138
    more = n - 1
    s18 = F.when(zero, F.floor(n / 138) + (left >= 11).cast("long")).otherwise(0)
    s17 = F.when(zero & left.between(3, 10), 1).otherwise(0)
    s16 = F.when(~zero, F.floor(more / 6) + (more % 6 >= 3).cast("long")).otherwise(0)
    literals = F.when(zero, F.when(left < 3, left).otherwise(0)).otherwise(1 + F.when(more % 6 < 3, more % 6).otherwise(0))
    return runs.groupBy(key).agg(*(F.sum(c).cast("long").alias(name) for c, name in ((s16, "s16"), (s17, "s17"), (s18, "s18"), (literals, "literals"))))


def canonical(lengths: DataFrame, symbol: str, bits: str, limit: int = 15) -> DataFrame:
    """Canonical codes: a code is the sum of what shorter and earlier ones take.

    ``written`` is the code as a stream that begins with the low bit has it.  An
    alphabet has at most some thousand symbols, so its window is short.
    """
    unit = F.expr(f"shiftleft(1L, {limit} - {bits})")
    before = Window.partitionBy().orderBy(bits, symbol).rowsBetween(Window.unboundedPreceding, -1)
    used = lengths.filter(F.col(bits) > 0).select(symbol, bits, F.coalesce(F.sum(unit).over(before), F.lit(0)).alias("_sum"))
    coded = used.select(symbol, bits, F.expr(f"shiftright(_sum, {limit} - {bits})").alias("code"))
    return coded.withColumn("written", F.reverse(F.lpad(F.bin("code"), F.col(bits), F.lit("0"))))


def ac_symbols(blocks: DataFrame, key: str, zz: str = "zz") -> DataFrame:
    """``(key, place, run, zrl, symbol)`` of blocks in zig-zag order; narrow."""
    places = F.filter(F.transform(zz, lambda v, i: F.struct(i.alias("place"), v.alias("v"))), lambda s: (s["place"] > 0) & (s["v"] != 0))
    with_before = F.transform(
        F.col("_p"), lambda s, k: F.struct(s["place"].alias("place"), s["v"].alias("v"), (s["place"] - F.coalesce(F.get("_p", k - 1)["place"], F.lit(0)) - 1).alias("run"))
    )
    rows = blocks.select(key, places.alias("_p")).select(key, F.inline(with_before))
    symbol = (F.col("run") % 16) * 16 + C.magnitude_bits(F.col("v"))
    return rows.select(key, "place", "run", F.floor(F.col("run") / 16).cast("int").alias("zrl"), symbol.cast("int").alias("symbol"))


def block_dct(df: DataFrame, key: str, samples: str, scale: int) -> DataFrame:
    """``(key, dct)``: the 8 x 8 DCT of 64 samples, as array code on Arrow batches."""
    import numpy as np
    import pyarrow as pa

    key_type = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, 8, 8)
            x = np.floor(np.abs(x) * scale + 0.5) * np.sign(x)  # half away from zero
            out = (BASIS @ x @ BASIS.T).reshape(-1, 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, "dct"])

    return df.filter(F.size(samples) == 64).select(key, F.col(samples).alias("s")).mapInArrow(run, f"{key} {key_type}, dct array<double>")


def block_fixed_dct(df: DataFrame, key: str, samples: str) -> DataFrame:
    """``(key, dct)``: the fixed-point DCT, times 8, of 64 samples 0..255, as array code on Arrow batches."""
    import numpy as np
    import pyarrow as pa

    key_type = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            out = fixed_dct(flat.reshape(-1, 8, 8)).reshape(-1)
            offsets = pa.array(np.arange(0, len(out) + 1, 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out, pa.int64()))], names=[key, "dct"])

    whole = df.filter((F.size(samples) == 64) & ~F.exists(samples, F.isnull))
    return whole.select(key, F.col(samples).cast("array<int>").alias("s")).mapInArrow(run, f"`{key}` {key_type}, dct array<bigint>")


def block_ends(blocks: DataFrame, key: str, zz: str = "zz") -> DataFrame:
    """``(key, last, ends)``: the last place that is not zero (0 for none), and if an end-of-block symbol follows it."""
    last = F.array_max(F.transform(zz, lambda v, i: F.when((i > 0) & (v != 0), i).otherwise(0)))
    return blocks.select(key, last.alias("last")).withColumn("ends", F.col("last") < 63)


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``(key, verdict)`` of rows that are missing from, added to or changed in ``b``."""
    values = [c for c in a.columns if c not in key]
    one = a.select(*key, F.struct(*values).alias("_a"))
    two = b.select(*key, F.struct(*values).alias("_b"))
    both = one.join(two, key, "full")
    verdict = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, verdict.alias("verdict"))


def states_at_bands(df: DataFrame, key: str, slot: str, value: str, at: str, size: int) -> DataFrame:
    """``(key, band, slot, value)``: the last value of every slot before each band but the first.

    Each band's last value of a slot is found first; what a later band sees is the
    newest of those, so rows are combined before anything is carried on.
    """
    band = F.floor(F.col(at) / size).cast("int")
    last = df.groupBy(key, slot, band.alias("_b")).agg(F.max_by(value, at).alias("_v"))
    until = F.lead("_b").over(Window.partitionBy(key, slot).orderBy("_b"))
    ends = df.groupBy(key).agg(F.max(band).alias("_end"))
    spans = last.withColumn("_until", until).join(ends, key)
    stop = F.coalesce("_until", "_end")
    return spans.filter(F.col("_b") < stop).select(key, F.explode(F.sequence(F.col("_b") + 1, stop)).alias("band"), slot, F.col("_v").alias(value))
