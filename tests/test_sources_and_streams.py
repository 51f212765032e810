"""Sources, the file sink, and bands that come as a stream."""

import random

import numpy as np
import pytest

from rasterloom.functions import png
from rasterloom.operators import bands, images
from rasterloom.sources import images as sources
from rasterloom.sources.raster_files import RasterFiles
from rasterloom.streaming import bands_stream


def test_files_are_checked_by_their_sums(spark, tmp_path):
    for name, content in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(content)
    found = sources.files(spark, str(tmp_path))
    digests = {r.path[-5:]: r.digest for r in found.collect()}
    sums = spark.createDataFrame([("a.bin", digests["a.bin"]), ("b.bin", "0" * 64)], "name string, known string")
    assert {r.name: r.verdict for r in sources.checked(found, sums).collect()} == {"a.bin": "known", "b.bin": "changed", "c.bin": "unknown"}


def test_made_images_round_trip_through_files(spark, tmp_path):
    spark.dataSource.register(RasterFiles)
    made = []
    for k, kind in enumerate(("page", "ui", "gradient", "flat", "noise")):
        pixels = sources.synthetic(spark, kind, 50, 20, image_id=k)
        rows = sources.gathered(pixels, ["r", "g", "b"])
        got = {r.y: bytes(r.raw) for r in rows.collect()}
        assert sorted(got) == list(range(20)) and all(len(v) == 150 for v in got.values())
        layout = png.layout_of("nrgba", 50, 20, True)
        data = np.frombuffer(b"".join(got[y] for y in range(20)), np.uint8).reshape(20, 150)
        made.append((f"{kind}.png", bytearray(png.encode(data, layout)), data))
        again = sources.opened(rows, ["r", "g", "b"])
        assert again.exceptAll(pixels).count() == 0 and again.count() == 1000
    spark.createDataFrame([m[:2] for m in made], "name string, file binary").write.format("rasterfiles").mode("append").save(str(tmp_path))
    back = {r.name: bytes(r.file) for r in spark.read.format("rasterfiles").load(str(tmp_path)).collect()}
    assert back == {n: bytes(f) for n, f, _ in made}
    decoded = sources.decoded(spark, str(tmp_path)).collect()
    for r in decoded:
        data = next(d for n, _, d in made if r.image_id.endswith(n))
        assert (np.frombuffer(bytes(r.raw), np.uint8).reshape(20, 50, 3)[..., ::-1].reshape(20, 150) == data).all()
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("../x", bytearray(b"1"))], "name string, file binary").write.format("rasterfiles").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(n for n, _, _ in made)


def test_writers_that_fail_or_have_no_files_leave_nothing(tmp_path, monkeypatch):
    """A task may begin after the job was given up and its folders were cleared."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 7))
    writer = RasterFiles({"path": str(tmp_path)}).writer(None, False)
    batch = lambda *names: pa.RecordBatch.from_arrays([pa.array(names), pa.array([b"1"] * len(names))], names=["name", "file"])
    assert not writer.write(iter([])).files and not list(tmp_path.iterdir())
    with pytest.raises(ValueError):
        writer.write(iter([batch("a"), batch("b", "../x")]))
    assert not list(tmp_path.iterdir())
    writer.commit([writer.write(iter([batch("a", "b")]))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_inferred_layout_and_translation(spark):
    rows = [(1, "nrgba", bytearray([1, 2, 3, 255] * 4)), (2, "nrgba", bytearray([1, 2, 3, 254])), (3, "gray", bytearray([0, 0, 0, 0])), (4, "paletted", bytearray([1])), (5, "rgba", bytearray())]
    found = {r.id: (r.opaque, r.colour) for r in sources.inferred(spark.createDataFrame(rows, "id int, model string, raw binary")).collect()}
    assert found == {1: (True, 2), 2: (False, 6), 3: (True, 0), 4: (True, 3), 5: (True, 2)}
    moved = sources.translated(spark.createDataFrame([(1, 5, 7), (1, 6, 9)], "image_id int, y int, x int"))
    assert sorted((r.y, r.x) for r in moved.collect()) == [(0, 0), (1, 2)]


def test_bands_merge_in_order_and_first_errors_win(spark):
    parts = spark.createDataFrame([(1, 2, bytearray(b"c")), (1, 0, bytearray(b"a")), (2, 0, bytearray(b"x")), (1, 1, bytearray(b"b"))], "id int, band int, data binary")
    assert {r.id: bytes(r.data) for r in bands.merged(parts, "id", "band", "data").collect()} == {1: b"abc", 2: b"x"}
    errors = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (1, 0, None), (2, 0, None)], "id int, band int, error string")
    assert [tuple(r) for r in bands.first_errors(errors, "id", "band", "error").collect()] == [(1, "early")]


def cut(rng, stream, height):
    edges = sorted({0, height, *(rng.randrange(height) for _ in range(5))})
    out = [(stream, a, b, height, bytearray(f"{a}-{b}".encode())) for a, b in zip(edges, edges[1:])]
    rng.shuffle(out)
    return out


def test_bands_leave_in_row_order(spark):
    rng = random.Random(1)
    rows = [r for s in "abcdef" for r in cut(rng, s, 40)]
    rows += [("bad", 0, 5, 10, bytearray(b"")), ("bad", 3, 6, 10, bytearray(b"")), ("bad", 5, 10, 10, bytearray(b""))]
    rows += [("wide", 0, 11, 10, bytearray(b"")), ("gap", 5, 10, 10, bytearray(b"")), ("gap", 6, 7, 10, bytearray(b"")), ("open", 4, 10, 10, bytearray(b""))]
    df = spark.createDataFrame(rows, bands_stream.INPUT).coalesce(1)
    out = bands_stream.reorder_batch(df).collect()
    for s in "abcdef":
        got = sorted((r for r in out if r.stream == s), key=lambda r: r.seq)
        assert [r.y0 for r in got] == [0, *(r.y1 for r in got[:-1])] and got[-1].y1 == 40
        assert all(bytes(r.data) == f"{r.y0}-{r.y1}".encode() for r in got)
    errors = {s: [r.error for r in out if r.stream == s and r.error] for s in ("bad", "wide", "gap")}
    assert errors["bad"][0].startswith("overlaps") and errors["bad"][1].startswith("closed") and "outside" in errors["wide"][0] and errors["gap"][0].startswith("overlaps")
    heights = spark.createDataFrame([(s, 40 if len(s) == 1 else 10) for s in (*"abcdef", "bad", "open")], "stream string, height long")
    left = bands_stream.unfinished(spark.createDataFrame(out, bands_stream.OUTPUT), heights)
    assert {(r.stream, r.reached) for r in left.collect()} == {("bad", 5), ("open", 0)}
    with pytest.raises(ValueError):
        bands_stream.header(0, 1, 0, 8)
    assert bands_stream.header(3, 4, 0, 8).startswith(png.SIGNATURE)


def test_a_stream_of_files_keeps_its_state(spark, tmp_path):
    bands_stream.use_rocksdb(spark)
    rng = random.Random(2)
    rows = [r for s in ("s1", "s2") for r in cut(rng, s, 30)] + [("s3", 0, 2, 9, bytearray(b"x")), ("s3", 1, 3, 9, bytearray(b"y"))]
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k:k + 3], bands_stream.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(bands_stream.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = bands_stream.reorder(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    for s in ("s1", "s2"):
        got = sorted((r for r in out if r.stream == s), key=lambda r: r.seq)
        assert [r.y0 for r in got] == [0, *(r.y1 for r in got[:-1])] and got[-1].y1 == 30
    assert len([r for r in out if r.stream == "s3" and r.error]) == 1


def test_halo_and_whole_images_agree(spark, tiny):
    whole = images.from_text(spark.read.parquet(f"{tiny}/documents.parquet"))
    a = images.row_filters(whole).collect()
    b = images.row_filters_halo(images.scanlines(whole)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_images_that_cannot_be_decoded_are_rows(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    (row,) = sources.decoded(spark, str(tmp_path)).collect()
    assert row.image_id.endswith("broken.png") and row.error == "cannot be decoded"
    assert row.height is None and row.row_bytes is None and row.raw is None
