"""Pictures of all colour models through the DataFrame forms, held against decoders."""

import numpy as np
import pytest

from rasterloom.functions import gif, png, tiff, webp
from rasterloom.operators import pictures
from rasterloom.sources import images as sources

RNG = np.random.default_rng(5)
SIZES = [(1, 1), (1, 37), (17, 3), (61, 49)]
SCHEMA = "image_id string, width int, height int, model string, raw binary, palette binary"
PALETTE = bytes(int(v) for k in range(200) for v in (k, 2 * k % 256, 255 - k, 255 if k % 7 else 40))


def made():
    rows = []
    for model, channels in pictures.CHANNELS.items():
        for w, h in SIZES:
            for opaque in (True, False):
                top = 200 if model == "paletted" else 65536 if model in pictures.DEEP else 256
                x = RNG.integers(0, top, (h, w, channels)).astype("<u2" if model in pictures.DEEP else np.uint8)
                if channels == 4 and model != "cmyk":
                    x[..., 3] = top - 1 if opaque else x[..., 3]
                    if model in ("rgba", "rgba64"):  # colours are within their alpha
                        x[..., :3] = np.minimum(x[..., :3], x[..., 3:])
                rows.append((f"{model}-{w}x{h}-{opaque}", w, h, model, x.tobytes(), PALETTE if model == "paletted" else None, x))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def df(spark, rows):
    bad = [("bad-model", 1, 1, "hsv", b"abc", None), ("bad-size", 4, 4, "gray", b"abc", None), ("bad-empty", 0, 3, "gray", b"", None), ("bad-palette", 1, 1, "paletted", b"\x09", b"\0" * 8), ("bad-null", 1, 1, None, None, None)]
    return spark.createDataFrame([r[:6] for r in rows] + bad, SCHEMA).repartition(4)


def whole(row):
    return pictures.straight(row[6], row[3], pictures.colours(row[5]) if row[5] else ())


def by_id(found):
    rows = {r.image_id: r for r in found.collect()}
    for k, r in rows.items():
        assert (r.file is None) == (r.error is not None) == k.startswith("bad"), (k, r.error)
    return {k: bytes(r.file) for k, r in rows.items() if r.file is not None}


def png_pixels(file):
    layout = png.read_layout(file)
    lines = png.decode_rows(b"".join(d for k, d in png.chunks(file) if k == "IDAT"), layout)
    if layout.depth < 8:
        lines = np.unpackbits(lines, axis=1).reshape(layout.height, -1, layout.depth)
        lines = (lines << np.arange(layout.depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2)[:, :layout.width]
    if layout.depth == 16:
        lines = np.ascontiguousarray(lines).view(">u2").astype(np.uint16)
    return layout, lines.reshape(layout.height, layout.width, -1)


def test_png_of_every_model(df, rows):
    for options in ({}, {"options": png.Options(fast=True)}):
        found = by_id(pictures.files(df, "png", **options))
        assert len(found) == len(rows)
        for row in rows:
            layout, x = png_pixels(found[row[0]])
            want = whole(row)
            if row[3] == "paletted":
                assert layout.colour == png.PALETTE and (x == row[6]).all()
            elif row[3].startswith("gray"):
                assert layout.colour == png.GRAY and (x == row[6]).all()
            else:
                assert layout.depth == (16 if row[3] in pictures.DEEP else 8)
                assert (x == want[..., :x.shape[2]]).all() and (x.shape[2] == 4 or (want[..., 3] == want.max(initial=255)).all() or row[3] == "cmyk")


def test_layouts_follow_from_the_pixels(df, rows):
    found = {r.image_id: r for r in pictures.inferred(df).collect()}
    for row in rows:
        r = found[row[0]]
        if row[3] in ("rgba", "nrgba", "rgba64", "nrgba64"):
            assert r.opaque == bool((whole(row)[..., 3] == (65535 if row[3] in pictures.DEEP else 255)).all())
            assert (r.colour, r.depth) == (2 if r.opaque else 6, 16 if row[3] in pictures.DEEP else 8)
        if row[3] == "gray16":
            assert (r.colour, r.depth, r.row_bytes) == (0, 16, 2 * row[1])


@pytest.mark.parametrize("compression, predictor", [("none", False), ("deflate", True), ("lzw", True)])
def test_tiff_of_every_model(df, rows, compression, predictor):
    icc = bytes(range(100))
    found = by_id(pictures.files(df, "tiff", compression=compression, predictor=predictor, icc=icc, strip_bytes=600, n_workers=3).filter("image_id != 'bad-palette'"))
    for row in rows:
        assert (tiff.decode(found[row[0]]) == row[6]).all(), row[0]
        assert bytes(tiff.parse(found[row[0]])[0][34675]) == icc


def test_gif_jpeg_and_webp(df, rows):
    small = df.filter("width * height < 100")
    gifs, webps, jpegs = (by_id(pictures.files(small, k, **o)) for k, o in (("gif", {}), ("webp", {}), ("jpeg", {"quality": 90, "subsample": False})))
    for row in rows:
        if row[1] * row[2] >= 100:
            continue
        (indices, table), = gif.decode(gifs[row[0]])
        assert indices.shape == row[6].shape[:2]
        if row[3] == "paletted":
            assert (indices == row[6][..., 0]).all() and (table[:200] == np.frombuffer(PALETTE, np.uint8).reshape(-1, 4)[:, :3]).all()
        assert webp.parse(webps[row[0]])[0][0] == "VP8L" and jpegs[row[0]][:2] == b"\xff\xd8" and jpegs[row[0]][-2:] == b"\xff\xd9"


def test_photographs_go_from_file_to_file(spark, tmp_path):
    y, x = np.mgrid[0:50, 0:70]
    rgb = np.stack([3 * y, 2 * x, (y + x)], -1).astype(np.uint8)
    alpha = np.dstack([rgb, (x * 3 % 256).astype(np.uint8)])
    for name, image, model in (("a", rgb, "rgb"), ("b", alpha, "nrgba"), ("c", rgb[..., :1], "gray")):
        (tmp_path / f"{name}.png").write_bytes(pictures.png_file(image, model))
    (tmp_path / "d.png").write_bytes(b"no image")
    read = pictures.from_decoded(sources.decoded(spark, str(tmp_path)))
    again = {r.image_id.rsplit("/", 1)[-1]: r for r in pictures.files(read, "png").collect()}
    assert again["d.png"].file is None and again["d.png"].error
    for name, image in (("a", rgb), ("b", alpha), ("c", rgb[..., :1])):
        layout, got = png_pixels(bytes(again[f"{name}.png"].file))
        assert (layout.width, layout.height) == (70, 50)
        assert (got == (image if got.shape[2] == image.shape[2] else image[..., :got.shape[2]])).all()


def test_animations_of_given_frames(spark):
    rows = []
    for key, model in (("p", "paletted"), ("n", "nrgba")):
        for k in range(5):
            w, h = (40, 30) if k % 2 == 0 else (20, 10)
            x = RNG.integers(0, 200, (h, w, pictures.CHANNELS[model])).astype(np.uint8)
            rows.append((key, k, w, h, model, x.tobytes(), PALETTE if model == "paletted" else None, 4 * (k % 2), 6 * (k % 2), 40 + 10 * k, k % 3, k % 2))
    frames = spark.createDataFrame(rows, "key string, frame int, width int, height int, model string, raw binary, palette binary, x int, y int, delay_ms long, dispose int, blend int").orderBy("raw")
    for r in pictures.animations(frames, "key", "apng", loops=3).collect():
        found = png.chunks(bytes(r.file))
        controls = [d for k, d in found if k == "fcTL"]
        own = [x for x in rows if x[0] == r.key]
        assert len(controls) == 5 and [int.from_bytes(c[4:8]) for c in controls] == [x[2] for x in own] and [int.from_bytes(c[12:16]) for c in controls] == [x[7] for x in own]
        assert [tuple(c[24:26]) for c in controls] == [(x[10], x[11]) for x in own]
    moving = {r.key: r for r in pictures.animations(frames, "key", "gif").collect()}
    assert moving["n"].file is None and "palette" in moving["n"].error
    for (indices, _), x in zip(gif.decode(bytes(moving["p"].file)), [x for x in rows if x[0] == "p"]):
        assert indices.tobytes() == x[5]
    for r in pictures.animations(frames, "key", "webp").collect():
        kinds = [k for k, _ in webp.parse(bytes(r.file))]
        assert kinds == ["VP8X", "ANIM"] + ["ANMF"] * 5
    odd = frames.withColumn("x", frames.x + 1)
    assert all(r.file is None and r.error for r in pictures.animations(odd, "key", "webp").collect())
