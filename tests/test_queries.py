"""Every query against its SQL on the smallest tables; the others against decoders."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import lzw, png
from rasterloom.operators import bands, encode, images
from rasterloom.plans import registry
from rasterloom.plans.common import text_images

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, tiny, duck, name):
    got = registry.QUERIES[name](spark, tiny)
    columns = sorted(got.columns)
    found = duck.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})")
    assert [KINDS[t] for _, t in sorted(got.dtypes)] == [str(d[1]) for d in found.description]
    rows = sorted(tuple(map(str, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(str, r)) for r in found.fetchall()) and rows


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_file_queries_give_rows(spark, tiny, name):
    got = registry.QUERIES[name](spark, tiny)
    rows = got.collect()
    assert rows
    assert "error" not in got.columns or all(r.error is None for r in rows)


def rows_of(spark, tiny):
    return {r.image_id: np.frombuffer(bytes(r.raw), np.uint8).reshape(-1, 64) for r in text_images(spark, tiny).filter("height > 0").collect()}


def test_files_hold_their_images(spark, tiny):
    whole = rows_of(spark, tiny)
    source = text_images(spark, tiny).filter("height > 0")
    heights = source.select("image_id", F.col("height").cast("long").alias("height"))
    for made in (encode.png_files(source), encode.png_files(source, png.Options(fast=True)), encode.png_bands(images.scanlines(source), heights, 64, 16), encode.png_bands(images.scanlines(source), heights, 64, 700)):
        found = made.collect()
        assert len(found) == len(whole)
        for r in found:
            layout = png.read_layout(bytes(r.file))
            stream = b"".join(d for k, d in png.chunks(bytes(r.file)) if k == "IDAT")
            assert (png.decode_rows(stream, layout) == whole[r.image_id]).all()


def test_streams_hold_their_bytes(spark, tiny):
    whole = rows_of(spark, tiny)
    source = text_images(spark, tiny).filter("height > 0")
    for r in encode.lzw_streams(source, "gif").collect():
        assert lzw.gif_decode(bytes(r.stream), 8) == whole[r.image_id].tobytes()
    for r in encode.lzw_streams(source, "tiff").collect():
        assert lzw.tiff_decode(bytes(r.stream)) == whole[r.image_id].tobytes()


def test_lengths_fit_the_counts(spark, tiny):
    rows = registry.QUERIES["huffman_lengths"](spark, tiny).collect()
    for alphabet in range(4):
        own = [r.bits for r in rows if r.alphabet == alphabet]
        assert max(own) <= 15 and sum(2.0**-b for b in own) == 1


def test_an_image_without_rows_is_an_error_row(spark):
    df = spark.createDataFrame([(1, ""), (2, "some bytes")], "doc_id long, text string")
    found = {r.image_id: r for r in encode.png_files(images.from_text(df)).collect()}
    assert found[1].file is None and "row" in found[1].error and found[2].error is None


def test_offsets_of_a_table_with_more_columns(spark, tmp_path):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"), F.concat(F.lit("x"), "id").alias("other"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    path = str(tmp_path / "whole")
    bands.offsets_by_bucket(df, "k", "n", 16).write.parquet(path)
    seven = lambda k: F.expr(f"({k} div 7) * 21 + (({k} % 7) * ({k} % 7 - 1)) div 2")
    assert spark.read.parquet(path).filter(F.col("offset") != seven("k")).count() == 0
    assert spark.read.parquet(path).count() == n
    small = df.filter("k % 5 = 0").withColumn("name", F.lpad(F.col("k").cast("string"), 8, "0"))
    plain = Window.partitionBy("g").orderBy("k")
    for key in ("k", "name"):  # by group, and by a column that has no quantiles
        got = bands.offsets_by_bucket(small, [key], "n", 16, ["g"], 3)
        want = small.withColumn("w", F.coalesce(F.sum("n").over(plain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 3).select("k", "w")
        assert got.join(want, "k").filter("offset != w").count() == 0 and got.count() == n // 5
    got = bands.previous_by_bucket(small, "k", "n", -1, 16, ["g"])
    want = small.withColumn("w", F.lag("n", 1, -1).over(plain)).select("k", "w")
    assert got.join(want, "k").filter("previous != w").count() == 0
    assert bands.offsets_by_bucket(df.limit(0), "k", "n").count() == 0


def test_adler_of_bands_is_that_of_the_whole(spark, tiny):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = registry.QUERIES["adler32_band_fold"](spark, tiny).collect()
    assert rows and all(r.adler == zlib.adler32(texts[r.doc_id]) for r in rows)


def test_hot_queries_scan_only_what_they_need(spark, tiny):
    plan = registry.QUERIES["any_all_flags"](spark, tiny)._jdf.queryExecution().toString()
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0]
    assert set(c.split(":")[0] for c in schema.split(",")) == {"o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"}
