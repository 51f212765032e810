"""Bands, chunks and their order: partition keys, offsets, folds, ordered merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.bands import split


def cut(df: DataFrame, height: str, least: int, align: int, workers: int, per_worker: int) -> DataFrame:
    """A row per band, with ``band``, ``y0`` and ``y1``; other columns are kept."""
    cuts = C.band_cuts(height, str(least), str(align), str(workers), str(per_worker))
    with_cuts = df.withColumn("_cuts", cuts)
    return with_cuts.select(
        *df.columns, "_cuts", F.posexplode("_cuts").alias("band", "y0")
    ).select(*df.columns, "band", F.col("y0").cast("long").alias("y0"), F.coalesce(F.get("_cuts", F.col("band") + 1), F.col(height)).cast("long").alias("y1"))


def sub_blocks(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """``(id, seq, first, n_bytes)``: a length ``n`` in blocks of a bounded size; narrow."""
    seq = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1))
    rows = df.filter("n > 0").select(id_col, "n", seq.alias("seq"))
    return rows.select(id_col, "seq", (F.col("seq").cast("long") * size).alias("first"), F.least(F.lit(size), F.col("n") - F.col("seq") * size).cast("int").alias("n_bytes"))


def offsets(df: DataFrame, group: list[str], order: list[str], size: Column, start: int = 0) -> DataFrame:
    """``offset``: what stands before each row of its group, in order."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)) + start)


def bucket_of(df: DataFrame, order: str, buckets: int) -> Column:
    """The number of the range of ``order`` a row falls into, from 0; nulls come first.

    The bounds are a few values found beforehand, so the number depends on the row
    alone, whatever plan it is worked out in.  They only decide how even ranges are.
    """
    numeric = dict(df.dtypes)[order].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
    if numeric:
        at = [i / buckets for i in range(1, buckets)]
        found = df.agg(F.percentile_approx(order, at, 10 * buckets)).first()[0] or [] if at else []
    else:  # those of least hash among the distinct values, a bounded list
        rows = df.select(order).distinct().filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(16 * buckets).collect()
        found = sorted(r[0] for r in rows)[::16]
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0)
    kind = df.schema[order].dataType
    step = max(1, int(len(bounds) ** 0.5))
    whole, coarse = F.array(*map(F.lit, bounds)).cast(f"array<{kind.simpleString()}>"), F.array(*map(F.lit, bounds[step - 1::step])).cast(f"array<{kind.simpleString()}>")
    below = lambda bound: bound < F.col(order)
    # how many bounds lie below: whole steps first, then within one
    steps = F.size(F.filter(coarse, below)) * step
    return F.when(F.col(order).isNull(), 0).otherwise(steps + F.size(F.filter(F.slice(whole, steps + 1, step), below)))


def _by_bucket(df: DataFrame, group: list[str], order: list[str], buckets: int) -> tuple[DataFrame, Window]:
    keyed = df.withColumn("_part", bucket_of(df, order[0], buckets))
    return keyed, Window.partitionBy(*group, "_part").orderBy(*order)


def _with_base(keyed: DataFrame, base: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what is known of their group's bucket; a row a group and bucket, joined as its size allows."""
    renamed = base.select(*(F.col(c).alias(f"_of_{c}") for c in (*group, "_part")), *(c for c in base.columns if c not in {*group, "_part"}))
    meets = F.lit(True)
    for c in (*group, "_part"):
        meets = meets & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return keyed.join(renamed, meets).drop(*(f"_of_{c}" for c in (*group, "_part")))


def offsets_by_bucket(df: DataFrame, order: str | list[str], size: str, buckets: int = 256, group: list[str] = (), start: int = 0) -> DataFrame:
    """``offset`` within each group - or the whole table - in the order of columns, no group being one task.

    The range of the first order column is cut into buckets; sums of a group's
    buckets are added up and rows are summed within their bucket.  Rows that tie
    in all order columns stand in any order.
    """
    order, group = [order] if isinstance(order, str) else list(order), list(group)
    keyed, within = _by_bucket(df, group, order, buckets)
    sums = keyed.groupBy(*group, "_part").agg(F.sum(size).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _with_base(keyed.withColumn("_local", local), base, group)
    return placed.withColumn("offset", F.col("_base") + F.col("_local") + start).drop("_part", "_base", "_local")


def previous_by_bucket(df: DataFrame, order: str | list[str], value: str, default, buckets: int = 256, group: list[str] = ()) -> DataFrame:
    """``previous``: the value of the row before in its group, no group being one task.

    A bucket's first row takes the last value of the bucket before it that has rows.
    """
    order, group = [order] if isinstance(order, str) else list(order), list(group)
    keyed, within = _by_bucket(df, group, order, buckets)
    lasts = keyed.groupBy(*group, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_part")
    base = lasts.select(*group, "_part", F.lag("_last").over(before).alias("_before"))
    placed = _with_base(keyed.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(within)), base, group)
    found = F.coalesce("_own", "_before")
    return placed.withColumn("previous", F.when(found.isNull(), F.lit(default)).otherwise(found["v"])).drop("_part", "_own", "_before")


def band_sums(df: DataFrame, id_col: str, row_bytes: int, least_rows: int, workers: int, per_worker: int) -> DataFrame:
    """``(id, band, a, b, n)``: Adler-32's two halves of every band's bytes."""
    import zlib

    id_type = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                cuts = split(-(-len(raw) // row_bytes), least_rows, 1, workers, per_worker)
                for band, (y0, y1) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[y0 * row_bytes:y1 * row_bytes]
                    s = zlib.adler32(part)
                    ids.append(k)
                    out.append((band, s & 0xFFFF, s >> 16, len(part)))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(ids, np.int64))), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["id", "band", "a", "b", "n"],
            )

    return df.select(id_col, "raw").mapInArrow(run, f"id {id_type}, band int, a long, b long, n long")


def folded_adler(df: DataFrame, id_col: str, row_bytes: int, least_rows: int, workers: int, per_worker: int) -> DataFrame:
    """``(id, bands, adler)`` folded from the bands' sums, in their order."""
    sums = band_sums(df, id_col, row_bytes, least_rows, workers, per_worker)
    # the number of bands of an image is bounded by workers * per_worker
    ordered = F.sort_array(F.collect_list(F.struct("band", "a", "b", "n")))
    return sums.groupBy(F.col("id").alias(id_col)).agg(ordered.alias("parts")).select(id_col, F.size("parts").alias("bands"), C.adler_fold(F.col("parts")).alias("adler"))


def merged(df: DataFrame, id_col: str, order: str, data: str) -> DataFrame:
    """``(id, data)``: binary parts of a file joined in order; a file fits a task by nature."""
    return df.groupBy(id_col).agg(F.expr(f"listagg(`{data}`) within group (order by `{order}`)").alias("data"))


def first_errors(df: DataFrame, id_col: str, order: str, error: str) -> DataFrame:
    """The first error of each file in the order of its bands, whichever came first in time."""
    return df.filter(F.col(error).isNotNull()).groupBy(id_col).agg(F.min_by(error, order).alias("error"))


def overlaps(claims: DataFrame, key: list[str], y0: str = "y0", y1: str = "y1", order: list[str] | None = None) -> DataFrame:
    """``overlaps``: whether a range meets one that starts before it (or with it, earlier in order).

    Ranges are sorted once per key and held against the farthest end so far: no
    pairs are made.
    """
    before = Window.partitionBy(*key).orderBy(y0, *(order or [y1])).rowsBetween(Window.unboundedPreceding, -1)
    return claims.withColumn("overlaps", F.coalesce(F.max(y1).over(before) > F.col(y0), F.lit(False)))


def missing(claims: DataFrame, key: list[str], height: str, y0: str = "y0", y1: str = "y1") -> DataFrame:
    """``(key, first, stop)``: rows no range covers, from 0 to the height."""
    order = Window.partitionBy(*key).orderBy(y0, y1)
    reach = F.greatest(F.coalesce(F.max(y1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    ends = claims.groupBy(*key).agg(F.max(y1).alias("first"), F.max(height).alias("stop")).filter("first < stop")
    gaps = claims.select(*key, reach.alias("first"), F.least(F.col(y0), F.col(height)).alias("stop")).filter("first < stop")
    return gaps.unionByName(ends.select(*key, "first", "stop"))
