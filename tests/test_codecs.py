"""Encoders held against decoders: the standard library's, Spark's, or ones written here."""

import struct
import time
import zlib

import numpy as np
import pytest

from rasterloom.functions import bands, bits, blocks, deflate, gif, jpeg, lzw, png, predictors, prefix_codes, tiff, vp8l, webp
from rasterloom.operators import encode

RNG = np.random.default_rng(1)
STREAMS = [
    b"", b"a", b"ab" * 3000, bytes(200_000), bytes(RNG.integers(0, 4, 100_000, dtype=np.uint8)), bytes(RNG.integers(0, 256, 70_000, dtype=np.uint8)),
    bytes(np.repeat(RNG.integers(0, 256, 900, dtype=np.uint8), RNG.integers(1, 600, 900))),
]


# --- bits and codes


def test_bits_pack_and_splice():
    values, widths = RNG.integers(0, 1 << 13, 5000), RNG.integers(0, 14, 5000)
    values &= (1 << widths) - 1
    whole = bits.code_bits(values, widths)
    reader = bits.LsbReader(bits.pack(whole))
    assert [reader.take(int(n)) for n in widths] == values.tolist()
    cuts = np.sort(RNG.integers(0, 5000, 30))
    parts = [bits.code_bits(v, n) for v, n in zip(np.split(values, cuts), np.split(widths, cuts))]
    assert bits.splice([(bits.pack(p), len(p)) for p in parts]) == (bits.pack(whole), len(whole))


def test_lengths_are_complete_and_limited():
    for _ in range(300):
        counts = (RNG.zipf(1.2, 60) % 100_000) * (RNG.random(60) < 0.6)
        limit = int(RNG.integers(6, 16))
        lengths = prefix_codes.limited_lengths(counts, limit)
        used = lengths[lengths > 0].astype(float)
        assert (lengths > 0).sum() == (counts > 0).sum() and lengths.max() <= limit
        assert len(used) < 2 or (2.0**-used).sum() == 1
        codes = prefix_codes.canonical(lengths, reverse=False)
        written = [f"{codes[s]:0{lengths[s]}b}" for s in np.flatnonzero(lengths)]
        assert all(a == b or not b.startswith(a) for a in written for b in written)
    plain = prefix_codes.limited_lengths([5, 9, 12, 13, 16, 45], 15)
    assert sorted(plain.tolist()) == [1, 3, 3, 3, 4, 4]


@pytest.mark.parametrize("first", [0, 8])
def test_run_lengths_say_the_lengths(first):
    for _ in range(400):
        lengths = np.repeat(RNG.integers(0, 4, 12), RNG.integers(1, 160, 12) if RNG.random() < 0.5 else RNG.integers(1, 9, 12))
        out, before = [], first
        for symbol, extra, _ in prefix_codes.run_lengths(lengths, first):
            if symbol < 16:
                out.append(symbol)
            else:
                out += [before if symbol == 16 else 0] * (extra + (3 if symbol < 18 else 11))
            if not first or out[-1]:
                before = out[-1]
        assert out == lengths.tolist()


# --- deflate


@pytest.mark.parametrize("data", STREAMS, ids=range(len(STREAMS)))
def test_bands_inflate_to_their_data(data):
    for cuts in ([0, len(data)], [0, len(data) // 3, len(data) // 2, len(data)]):
        pairs = list(zip(cuts, cuts[1:]))
        made = [(deflate.deflate_band(data[a:b], data[:a], k == len(pairs) - 1), zlib.adler32(data[a:b]), b - a) for k, (a, b) in enumerate(pairs)]
        assert zlib.decompress(deflate.join_bands(made)) == data
        for distance in (1, 3, 4, 8):
            fast = b"".join(deflate.fast_deflate(data[a:b], distance, k == len(pairs) - 1) for k, (a, b) in enumerate(pairs))
            assert zlib.decompress(fast, -15) == data


def test_headers_and_sums():
    for level in range(-1, 10):
        assert deflate.zlib_header(level) == zlib.compress(b"x", level)[:2]
    for _ in range(200):
        a, b = (RNG.integers(0, 256, int(RNG.integers(0, 99_999)), dtype=np.uint8).tobytes() for _ in "ab")
        assert deflate.adler_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert deflate.distance_symbol(1) == (0, 0, 0) and deflate.distance_symbol(5) == (4, 1, 0) and deflate.distance_symbol(32768) == (29, 13, 8191)


def test_a_registered_compressor_is_used():
    calls = []

    def factory(level, dictionary):
        calls.append((level, len(dictionary)))
        return deflate.zlib_factory(level, dictionary)

    deflate.register("counted", factory)
    rows = RNG.integers(0, 9, (64, 700), dtype=np.uint8)
    layout = png.layout_of("gray", 700, 64, True)
    file = png.encode(rows, layout, png.Options(compressor="counted", workers=3, band_bytes=1, band_rows=10))
    assert len(calls) > 1 and calls[0][1] == 0 and all(n > 0 for _, n in calls[1:])
    assert (png.decode_rows(b"".join(d for k, d in png.chunks(file) if k == "IDAT"), layout) == rows).all()


# --- filters and predictors


@pytest.mark.parametrize("bpp", [1, 2, 3, 4, 6, 8])
def test_filters_are_undone(bpp):
    for rows in (RNG.integers(0, 256, (20, 24), dtype=np.uint8), np.zeros((5, 24), np.uint8), RNG.integers(0, 3, (1, 24), dtype=np.uint8)):
        kinds, costs, residuals = predictors.select_filters(rows, bpp)
        assert (predictors.unfilter(kinds, residuals, bpp) == rows).all()
        for y in range(len(rows)):
            each = {k: predictors.signed_cost(predictors.filtered(rows, bpp, k))[y].sum() for k in predictors.TRIED}
            assert costs[y] == min(each.values()) and kinds[y] == next(k for k in predictors.TRIED if each[k] == costs[y])
    kinds, _, residuals = predictors.select_filters(rows, bpp, detached=True)
    assert kinds[0] in (predictors.NONE, predictors.SUB)


def test_horizontal_predictor_is_undone():
    for kind in (np.uint8, np.dtype("<u2")):
        for samples in (1, 3, 4):
            x = RNG.integers(0, np.iinfo(kind).max, (9, 24)).astype(kind)
            assert (predictors.undo_horizontal(predictors.horizontal(x, samples), samples) == x).all()


# --- PNG


MODELS = ["rgba", "nrgba", "gray", "gray16", "nrgba64", "paletted"]


def picture(model, h, w):
    channels = 4 if model in ("rgba", "nrgba", "nrgba64") else 1
    x = (np.indices((h, w)).sum(axis=0)[..., None] * np.arange(1, channels + 1) + RNG.integers(0, 4, (h, w, channels))) % 200
    if model == "rgba":
        x[..., 3] = 255
    return x.astype(np.uint16 if model.endswith("16") or model.endswith("64") else np.uint8)


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("size", [(1, 1), (37, 1), (3, 17), (199, 301)])
def test_png_holds_the_rows(model, size):
    h, w = size
    palettes = [200, 16, 4, 2] if model == "paletted" else [0]
    for colours in palettes:
        x = picture(model, h, w)
        if colours:
            x %= colours
        palette = [(i, 2 * i % 256, 3 * i % 256, 255 if i > 5 else 10 * i) for i in range(colours)]
        layout = png.layout_of(model, w, h, False, palette)
        rows = png.scanlines(x, model, layout)
        assert rows.shape == (h, layout.row_bytes)
        many = dict(workers=4, band_bytes=1, band_rows=5)
        for o in (png.Options(), png.Options(**many), png.Options(fast=True), png.Options(fast=True, **many), png.Options(level=0), png.Options(level=9, **many)):
            file = png.encode(rows, layout, o)
            assert png.read_layout(file) == layout
            assert (png.decode_rows(b"".join(d for k, d in png.chunks(file) if k == "IDAT"), layout) == rows).all()


def test_spark_reads_png_and_jpeg(spark, tmp_path):
    y, x = np.mgrid[0:120, 0:150]
    image = np.stack([y, x, (y + x) // 2], -1).astype(np.uint8)
    opaque = np.dstack([image, np.full(image.shape[:2], 255, np.uint8)])
    layout = png.layout_of("nrgba", 150, 120, True)
    (tmp_path / "a.png").write_bytes(png.encode(png.scanlines(opaque, "nrgba", layout), layout, png.Options(workers=4, band_bytes=1)))
    (tmp_path / "b.jpg").write_bytes(jpeg.encode(image, quality=90, n_workers=4))
    (tmp_path / "c.jpg").write_bytes(jpeg.encode(image, quality=90, n_workers=1))
    (tmp_path / "d.jpg").write_bytes(jpeg.encode(image[..., :1], "gray", 95))
    (tmp_path / "e.jpg").write_bytes(jpeg.encode(image, quality=100, subsample=False))
    got = {}
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        got[r.origin[-5]] = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(int)
    assert (got["a"] == image[..., ::-1]).all()
    assert (got["b"] == got["c"]).all()
    assert ((got["b"] - image[..., ::-1]) ** 2).mean() < 12 and ((got["e"] - image[..., ::-1]) ** 2).mean() < 3
    assert ((got["d"] - image[..., :1]) ** 2).mean() < 2


def test_errors_come_before_any_pixel():
    for size in ((0, 5), (5, 0), (1 << 32, 1)):
        with pytest.raises(ValueError):
            png.layout_of("gray", *size, True)
    for n in (0, 257):
        with pytest.raises(ValueError):
            png.layout_of("paletted", 3, 3, True, [(0, 0, 0, 255)] * n)
    with pytest.raises(ValueError):
        tiff.encode(np.zeros((0, 3, 1), np.uint8), "gray")
    with pytest.raises(ValueError):
        jpeg.encode(np.zeros((0, 3, 3), np.uint8))
    with pytest.raises(ValueError):
        webp.encode(np.zeros((1, 0, 4), np.uint8))


def test_apng_chunks():
    frames = [png.Frame(picture("nrgba", 30, 40), delay_ms=40)]
    frames += [png.Frame(picture("nrgba", 10 + k, 12), x=k, y=2 * k, delay_ms=50 + k, dispose=k % 3, blend=k % 2) for k in range(1, 5)]
    frames.append(png.Frame(RNG.integers(0, 255, (30, 40, 4)).astype(np.uint8)))
    file = png.encode_animation(frames, 3)
    found = png.chunks(file)
    kinds = [k for k, _ in found]
    assert kinds[:3] == ["IHDR", "acTL", "fcTL"] and kinds[-1] == "IEND" and "IDAT" in kinds
    assert struct.unpack(">2I", dict(found)["acTL"]) == (6, 3)
    serials = [struct.unpack(">I", d[:4])[0] for k, d in found if k in ("fcTL", "fdAT")]
    assert serials == list(range(len(serials)))
    streams, k = {}, -1
    for kind, data in found:
        if kind == "fcTL":
            k += 1
            assert struct.unpack(">4I", data[4:20]) == (frames[k].pixels.shape[1], frames[k].pixels.shape[0], frames[k].x, frames[k].y)
            assert tuple(data[24:26]) == (frames[k].dispose, frames[k].blend)
        elif kind in ("IDAT", "fdAT"):
            streams[k] = streams.get(k, b"") + (data if kind == "IDAT" else data[4:])
    for k, f in enumerate(frames):
        layout = png.Layout(f.pixels.shape[1], f.pixels.shape[0], png.RGBA, 8)
        assert (png.decode_rows(streams[k], layout) == f.pixels.reshape(len(f.pixels), -1)).all()
    for bad in ([], [frames[1]], [frames[0], png.Frame(picture("nrgba", 31, 2))], [frames[0], png.Frame(picture("nrgba", 2, 2), dispose=3)]):
        with pytest.raises(ValueError):
            png.encode_animation(bad)
    with pytest.raises(ValueError):
        png.encode_animation(frames[:1], -1)


def test_frames_share_a_layout():
    gray16, rgba, pal = png.Frame(picture("gray16", 5, 5), "gray16"), png.Frame(picture("nrgba", 5, 5)), tuple((i, i, i, 255) for i in range(200))
    one, two = png.Frame(picture("paletted", 5, 5), "paletted", palette=pal), png.Frame(picture("paletted", 5, 5), "paletted", palette=tuple(list(pal)))
    kinds = lambda *f: {(x.colour, x.depth) for x in png.common_layout(list(f), 5, 5)}
    assert kinds(one, two) == {(png.PALETTE, 8)}
    assert kinds(one, gray16) == {(png.RGB, 8)} and kinds(gray16, gray16) == {(png.RGB, 16)} and kinds(gray16, rgba) == {(png.RGBA, 8)}
    for mix in ([one, gray16], [gray16, gray16], [gray16, rgba], [one, rgba]):
        assert png.chunks(png.encode_animation(mix))


def test_delays():
    assert png.delay_fraction(40_000_000) == (40, 1000) and png.delay_fraction(-5) == (0, 1000)
    assert png.delay_fraction(70_000_000_000) == (7000, 100) and png.delay_fraction(700_000_000_000) == (700, 1)


# --- TIFF, LZW, GIF


@pytest.mark.parametrize("compression", ["none", "deflate", "lzw"])
@pytest.mark.parametrize("predictor", [False, True])
def test_tiff_holds_the_samples(compression, predictor):
    for kind in (np.uint8, np.uint16):
        for model, c in (("gray", 1), ("rgb", 3), ("nrgba", 4), ("cmyk", 4)):
            for h, w in ((1, 1), (7, 19), (90, 70)):
                x = RNG.integers(0, 60, (h, w, c)).astype(kind)
                file = tiff.encode(x, model, compression, predictor, n_workers=4, strip_bytes=3000, icc=b"profile")
                assert (tiff.decode(file) == x).all()
                tags, strips = tiff.parse(file)
                assert list(tags) == sorted(tags) and bytes(tags[34675]) == b"profile" and sum(tags[279]) == sum(map(len, strips))
                assert struct.unpack_from("<I", file, 4)[0] % 2 == 0
    x = RNG.integers(0, 9, (20, 20, 1)).astype(np.uint8)
    tags, _ = tiff.parse(tiff.encode(x, "paletted", compression, predictor, [(i, 2 * i, 3 * i, 255) for i in range(9)]))
    assert tags[320][:3] == [0, 257, 514] and len(tags[320]) == 768 and 317 not in tags


@pytest.mark.parametrize("data", STREAMS, ids=range(len(STREAMS)))
def test_lzw_is_undone(data):
    data = data[:60_000]
    assert lzw.tiff_decode(lzw.tiff_strip(data)) == data
    for cuts in ([0, len(data)], [0, len(data) // 3, len(data) // 2, len(data)]):
        pairs = list(zip(cuts, cuts[1:]))
        parts = [lzw.gif_band(data[a:b], 8, k == 0, k == len(pairs) - 1) for k, (a, b) in enumerate(pairs)]
        assert lzw.gif_decode(bits.splice(parts)[0], 8) == data


def test_lzw_of_every_length_near_the_width_changes():
    data = RNG.integers(0, 256, 9000, dtype=np.uint8).tobytes()
    for n in [*range(250, 262), *range(505, 520), *range(1015, 1030), *range(2040, 2055), *range(3830, 3850), *range(4080, 4110)]:
        assert lzw.tiff_decode(lzw.tiff_strip(data[:n])) == data[:n]
        assert lzw.gif_decode(lzw.gif_band(data[:n], 8, True, True)[0], 8) == data[:n]
    with pytest.raises(ValueError):
        lzw.gif_band(b"\x05", 2, True, True)


def test_gif_holds_the_frames():
    first, second = tuple((i, 0, i) for i in range(7)), tuple((i, 9, i) for i in range(200))
    x = RNG.integers(0, 7, (100, 90)).astype(np.uint8)
    frames = [gif.Frame(x, first, delay=3), gif.Frame(x[:40, :30], second, x=5, y=5, disposal=2, transparent=1), gif.Frame(x[:3, :3], first)]
    for workers, band in ((1, 1 << 20), (4, 500)):
        got = gif.decode(gif.encode(frames, 90, 100, 0, workers, band))
        for (indices, table), f in zip(got, frames):
            assert (indices == f.indices).all() and (table[:len(f.palette)] == np.array(f.palette)).all()
    clear = tuple((9, 9, 9, 0) if i == 3 else (i, 0, i, 255) for i in range(7))
    file = gif.encode([gif.Frame(x, first), gif.Frame(x, clear), gif.Frame(x % 2, first[:2])], 90, 100)
    assert file.count(b"\x21\xf9\x04\x01\x00\x00\x03\x00") == 1  # index 3 is see-through; all share one table
    assert all((table == gif.decode(file)[0][1]).all() for _, table in gif.decode(file))
    for bad in ([], [gif.Frame(x, first, x=1)], [gif.Frame(x, ())], [gif.Frame(x, first[:3])]):
        with pytest.raises(ValueError):
            gif.encode(bad, 90, 100)
    assert gif.sub_blocks(bytes(300)) == b"\xff" + bytes(255) + b"\x2d" + bytes(45) + b"\0"
    assert [gif.table_bits(n) for n in (1, 2, 3, 4, 5, 16, 17, 256)] == [0, 0, 1, 1, 2, 3, 4, 7]


def plain_dither(pixels, palette):
    h, w, c = pixels.shape
    carry = np.zeros((h + 1, w + 2, c), np.int64)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            value = [min(65535, max(0, int(pixels[y, x, k]) + int(carry[y, x + 1, k] / 16))) for k in range(c)]
            scores = [sum(((v - int(p[k])) ** 2) >> 2 for k, v in enumerate(value)) for p in palette]
            out[y, x] = scores.index(min(scores))
            error = np.array(value) - palette[out[y, x]]
            carry[y, x + 2] += error * 7
            carry[y + 1, x] += error * 3
            carry[y + 1, x + 1] += error * 5
            carry[y + 1, x + 2] += error
    return out


def test_dithering_and_palettes():
    for h, w in ((1, 1), (1, 20), (20, 1), (17, 23)):
        pixels = RNG.integers(0, 65536, (h, w, 4))
        palette = RNG.integers(0, 65536, (int(RNG.integers(1, 30)), 4))
        assert (gif.dither(pixels, palette) == plain_dither(pixels, palette)).all()
        assert (gif.nearest(palette[None], palette)[0] == [palette.tolist().index(p) for p in palette.tolist()]).all()
    assert len(np.unique(gif.plan9_palette(), axis=0)) == 256
    cut = gif.median_cut(RNG.integers(0, 256, (40, 40, 3)), 16)
    assert cut.shape == (16, 3)


def test_dithering_pictures_side_by_side(monkeypatch):
    rng = np.random.default_rng(7)
    for width, channels, colours in ((16, 4, 16), (1, 3, 2), (2, 1, 256), (7, 5, 9), (8, 4, 1)):
        pictures = [rng.integers(0, 65536, (h, width, channels)) // 21845 * 21845 if h % 2 else rng.integers(0, 65536, (h, width, channels)) for h in (0, 1, 2, 3, 9, 30, 17, 1, 5)]
        palette = rng.integers(0, 65536, (colours, channels))
        palette[:, -1] = 65535 if channels > 3 else palette[:, -1]  # alike in all colours
        palette[-1] = palette[0]  # of equals the first
        expected = [plain_dither(p, palette) for p in pictures]
        for at_once in (gif.AT_ONCE, 40):
            monkeypatch.setattr(gif, "AT_ONCE", at_once)
            assert all((a == b).all() for a, b in zip(gif.dither_all(pictures, palette), expected))
    with pytest.raises(ValueError):
        gif.dither_all([np.full((2, 2, 3), 65536)], np.array([[0, 0, 0], [9, 9, 9]]))


def test_dithered_images(spark):
    """Rows of several widths, stacks of few bytes, and what cannot be drawn; a million pixels take seconds, not minutes."""
    rng = np.random.default_rng(8)
    grays = np.array([[v, v, v, 255] for v in range(0, 256, 17)])
    rows = [(i, w, bytearray(rng.integers(0, 256, w * h, np.uint8).tobytes())) for i, (w, h) in enumerate([(64, 3), (8, 40), (64, 1), (4, 9), (64, 20), (8, 1)])]
    rows += [(90, 64, bytearray()), (91, 64, None), (92, 6, bytearray(12))]
    frame = spark.createDataFrame(rows, "image_id long, row_bytes int, raw binary").coalesce(1)
    for at_once in (8 << 20, 200):
        got = {r.image_id: r for r in encode.dithered(frame, grays, at_once).collect()}
        assert len(got) == len(rows)
        for i, width, raw in rows[:6]:
            pixels = np.frombuffer(bytes(raw), np.uint8).reshape(-1, width // 4, 4).astype(np.int64) * 257
            assert bytes(got[i].file) == plain_dither(pixels, grays * 257).astype(np.uint8).tobytes() and got[i].error is None
        assert all(got[i].file is None and got[i].error for i in (90, 91, 92))
    large = [rng.integers(0, 65536, (125, 16, 4)) for _ in range(500)]
    began = time.process_time()
    gif.dither_all(large, grays * 257)
    assert time.process_time() - began < 5


# --- JPEG parts


def test_blocks():
    assert blocks.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(blocks.ZIGZAG) == list(range(64))
    x = RNG.normal(size=(5, 8, 8))
    assert np.allclose(blocks.inverse_dct(blocks.forward_dct(x)), x)
    assert (blocks.quality_table(blocks.LUMA, 50) == blocks.LUMA).all() and (blocks.quality_table(blocks.LUMA, 100) == 1).all()
    zz = np.zeros((2, 64), int)
    zz[0, [0, 1, 40]] = 5, -3, 1
    zz[1, [0, 63]] = 2, 1
    got = list(zip(*(c.tolist() for c in blocks.block_symbols(zz))))
    assert [(b, s, v, n) for b, _, s, v, n in got] == [(0, 3, 5, 3), (0, 2, 0, 2), (0, 0xF0, 0, 0), (0, 0xF0, 0, 0), (0, 6 * 16 + 1, 1, 1), (0, 0, 0, 0), (1, 2, 0, 2), (1, 0xF0, 0, 0), (1, 0xF0, 0, 0), (1, 0xF0, 0, 0), (1, 14 * 16 + 1, 1, 1)]


def test_fixed_point_dct():
    """Within one of eight times the real transform; flat blocks and their steps exactly."""
    x = np.concatenate([RNG.integers(0, 256, (400, 8, 8)), RNG.integers(0, 2, (400, 8, 8)) * 255, np.arange(256)[:, None, None] + np.zeros((1, 8, 8), int)])
    got = blocks.fixed_dct(x)
    assert np.abs(got - 8 * blocks.forward_dct(x - 128.0)).max() <= 1
    assert (got[800:, 0, 0] == (np.arange(256) - 128) * 64).all() and not got[800:].reshape(256, 64)[:, 1:].any()


# --- WebP: a decoder after the specification


class Vp8l:
    def __init__(self, data):
        self.r = bits.LsbReader(data)

    def code(self, size):
        r = self.r
        if r.take(1):
            n = r.take(1) + 1
            symbols = [r.take(8 if r.take(1) else 1)]
            if n == 2:
                symbols.append(r.take(8))
            lengths = [0] * size
            for s in symbols:
                lengths[s] = 1
        else:
            own = [0] * 19
            for k in range(r.take(4) + 4):
                own[prefix_codes.VP8L_ORDER[k]] = r.take(3)
            assert r.take(1) == 0
            table, lengths, before = prefix_codes.decode_table(own), [], 8
            while len(lengths) < size:
                s = self.symbol(table)
                if s < 16:
                    lengths.append(s)
                    before = s or before
                else:
                    n = r.take({16: 2, 17: 3, 18: 7}[s]) + (11 if s == 18 else 3)
                    lengths += [before if s == 16 else 0] * n
            assert len(lengths) == size
        return prefix_codes.decode_table(lengths)

    def symbol(self, table):
        if len(table) == 1:
            return next(iter(table.values()))
        code = n = 0
        while True:
            code |= self.r.take(1) << n
            n += 1
            if (n, code) in table:
                return table[n, code]

    def value(self, s):
        if s < 4:
            return s + 1
        n = (s - 2) >> 1
        return ((2 + (s & 1)) << n) + self.r.take(n) + 1

    def image(self, w, h, main):
        cache_bits = self.r.take(4) if self.r.take(1) else 0
        if main:
            assert self.r.take(1) == 0
        codes = [self.code(n) for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)]
        out, cache = [], [0] * (1 << cache_bits)
        near = dict(enumerate(vp8l.NEAR, 1))

        def put(p):
            out.append(p)
            if cache_bits:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache_bits] = p

        while len(out) < w * h:
            s = self.symbol(codes[0])
            if s < 256:
                red, blue, alpha = (self.symbol(codes[k]) for k in (1, 2, 3))
                put(alpha << 24 | red << 16 | s << 8 | blue)
            elif s < 280:
                n = self.value(s - 256)
                d = self.value(self.symbol(codes[4]))
                d = max(1, near[d][0] + near[d][1] * w) if d <= 120 else d - 120
                for _ in range(n):
                    put(out[-d])
            else:
                put(cache[s - 280])
        return np.array(out, np.uint32)

    def decode(self):
        r = self.r
        assert r.take(8) == 0x2F
        w, h = r.take(14) + 1, r.take(14) + 1
        r.take(1)
        assert r.take(3) == 0
        assert (r.take(1), r.take(2)) == (1, 2) and (r.take(1), r.take(2), r.take(3)) == (1, 0, 2)
        tw = -(-w // 16)
        modes = self.image(tw, -(-h // 16), False) >> 8 & 255
        assert r.take(1) == 0
        residual = self.image(w, h, True)
        out = np.zeros((h, w, 4), np.uint8)
        split = np.stack([residual >> s & 255 for s in (24, 16, 8, 0)], -1).reshape(h, w, 4)
        for y in range(h):
            for x in range(w):
                window = np.zeros((2, 3, 4), np.uint8)
                mode = int(modes[(y // 16) * tw + x // 16])
                flat = out.reshape(-1, 4)
                i = y * w + x
                at = lambda n: flat[i - n].astype(int) if i >= n else np.zeros(4, int)  # noqa: B023, E731
                left, top, corner, right = at(1), at(w), at(w + 1), at(w - 1)
                if not x and not y:
                    guess = np.array([255, 0, 0, 0])
                elif not y or not x:
                    guess = left if not y else top
                else:
                    mean = lambda a, b: (a + b) // 2
                    near_left = np.abs(left + top - corner - left).sum() < np.abs(left + top - corner - top).sum()
                    m = mean(left, top)
                    guess = [
                        np.array([255, 0, 0, 0]), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right),
                        mean(mean(left, corner), mean(top, right)), left if near_left else top, np.clip(left + top - corner, 0, 255), np.clip(m + np.trunc((m - corner) / 2).astype(int), 0, 255),
                    ][mode]
                out[y, x] = (split[y, x] + guess) & 255
                del window
        return predictors.add_green(out)


@pytest.mark.parametrize("size", [(1, 1), (40, 1), (1, 40), (23, 17), (70, 64)])
@pytest.mark.parametrize("kind", ["flat", "photo", "noise", "alpha"])
def test_vp8l_decodes_to_the_pixels(size, kind):
    h, w = size
    x = np.zeros((h, w, 4), np.uint8)
    x[..., 0] = 255
    x[..., 1:] = {"flat": 9, "photo": (np.indices((h, w)).sum(axis=0)[..., None] * [1, 2, 3]) % 256 // 7 * 7, "noise": RNG.integers(0, 256, (h, w, 3)), "alpha": RNG.integers(0, 3, (h, w, 3))}[kind]
    if kind == "alpha":
        x[..., 0] = RNG.integers(0, 256, (h, w))
    for cuts in ([0, h], sorted({0, h // 3, h // 2, h})):
        assert (Vp8l(vp8l.encode(x, cuts)).decode() == x).all()


def test_webp_containers():
    x = RNG.integers(0, 9, (20, 30, 4)).astype(np.uint8)
    (kind, data), = webp.parse(webp.encode(x))
    assert kind == "VP8L" and (Vp8l(data).decode() == x).all()
    frames = [webp.Frame(x, 2, 4, 30), webp.Frame(x[:5, :7], 0, 0, 1 << 25, blend=True, dispose=True)]
    file = webp.encode_animation(frames, 0, 50, 7, (1, 2, 3, 4))
    found = webp.parse(file)
    assert [k for k, _ in found] == ["VP8X", "ANIM", "ANMF", "ANMF"] and len(file) % 2 == 0
    assert found[0][1][0] == 0x12 and int.from_bytes(found[0][1][4:7], "little") == 31 and int.from_bytes(found[0][1][7:10], "little") == 49
    assert found[1][1] == bytes([3, 2, 1, 4, 7, 0])
    assert int.from_bytes(found[2][1][:3], "little") == 1 and found[2][1][15] == 2 and found[3][1][15] == 1
    assert int.from_bytes(found[3][1][12:15], "little") == (1 << 24) - 1
    assert (Vp8l(webp.parse(found[3][1][16:])[0][1]).decode() == x[:5, :7]).all()
    for bad in ([], [webp.Frame(x, 1)], [webp.Frame(x, duration_ms=-1)], [webp.Frame(x, 40)]):
        with pytest.raises(ValueError):
            webp.encode_animation(bad, 31 if bad else 0, 50 if bad else 0)
    with pytest.raises(ValueError):
        webp.encode_animation(frames, loops=1 << 16)


def test_equal_frames_are_encoded_once(monkeypatch):
    """A picture shown again, as the same array or another, costs no second stream; files are as if each were encoded."""
    rng = np.random.default_rng(9)
    pictures = [rng.integers(0, 256, size, np.uint8) for size in ((16, 24, 4), (24, 16, 4), (80, 60, 4), (80, 60, 4))]
    pictures.append(np.zeros((16, 24, 4), np.uint8))
    turned = np.arange(16 * 24 * 4, dtype=np.uint8).reshape(24, 16, 4).transpose(1, 0, 2)  # not in one piece
    pictures += [turned, np.full((24, 16, 4), 7, np.uint8), np.full((16, 24, 4), 7, np.uint8)]
    order = [*range(8), *rng.integers(0, 8, 400).tolist()]
    frames = [webp.Frame(pictures[k] if n % 2 else pictures[k].copy(), duration_ms=n) for n, k in enumerate(order)]
    expected = [webp.chunk(b"VP8L", webp.image_stream(pictures[k])) for k in order]
    made, encode_picture = [], vp8l.encode
    monkeypatch.setattr(vp8l, "encode", lambda *a: made.append(1) or encode_picture(*a))
    webp._small_stream.cache_clear()
    shown = [data for kind, data in webp.parse(webp.encode_animation(frames)) if kind == "ANMF"]
    assert [data[16:] for data in shown] == expected and len(made) == 8
    webp.encode_animation(frames[:2])
    assert len(made) == 8  # small pictures are known to the next animation
    assert webp._small_stream.cache_info().maxsize * webp.SMALL <= 16 << 20


def test_references_find_the_pixels():
    x = np.tile(RNG.integers(0, 5, 200), 30).astype(np.uint32)
    for start in (0, 700):
        tokens = vp8l.references(x, start, len(x), 37)
        assert (vp8l.resolve(tokens, x[:start], 37) == x[start:]).all()
    assert any(k == vp8l.COPY for k, _, _ in tokens)
    codes = vp8l.near_codes(64)
    assert codes[1] == 2 and codes[64] == 1 and len(vp8l.NEAR) == 120 and len(set(vp8l.NEAR)) == 120


# --- bands


def test_split_covers_the_rows():
    for h, least, align, n, per in ((1500, 200, 1, 16, 2), (1500, 200, 8, 16, 2), (1500, 200, 16, 3, 2), (7, 200, 8, 16, 2), (100, 1, 1, 1, 4), (1, 1, 8, 8, 2), (1754, 70, 16, 16, 2)):
        cuts = bands.split(h, least, align, n, per)
        assert cuts[0] == 0 and cuts[-1] == h and all(a < b for a, b in zip(cuts, cuts[1:]))
        assert all(c % align == 0 for c in cuts[1:-1]) and (n > 1 or len(cuts) == 2)
    assert len(bands.split(100, 1, 8, 8, 2)) == 13 and bands.split(100, 1, 1, 8, 2)[1] == 6
    assert jpeg.interval_rows(4096, 4096, 1) == 15 and jpeg.interval_rows(94, 125, 16) == 5 and jpeg.interval_rows(20, 10, 1) == 20
    assert bands.workers(3) == 3 and bands.workers(0) >= 1


# --- streams of rows


def stretches(h, rng):
    cuts = sorted({0, h, *rng.integers(0, h, 6).tolist()})
    out = list(zip(cuts, cuts[1:]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("model", ["nrgba", "gray16", "paletted"])
def test_stream_writer_takes_bands_in_any_order(model):
    import io

    for h, w in ((1, 1), (21, 37), (200, 300)):
        x = picture(model, h, w)
        palette = [(i, i, i, 255) for i in range(200)] if model == "paletted" else []
        layout = png.layout_of(model, w, h, False, palette)
        rows = png.scanlines(x, model, layout)
        for o in (png.Options(), png.Options(fast=True), png.Options(workers=3, band_bytes=1, band_rows=7)):
            out = io.BytesIO()
            writer = png.StreamWriter(out, layout, o)
            for a, b in stretches(h, np.random.default_rng(h)):
                writer.write_rows(int(a), rows[a:b])
            writer.close()
            file = out.getvalue()
            assert (png.decode_rows(b"".join(d for k, d in png.chunks(file) if k == "IDAT"), layout) == rows).all()
            with pytest.raises(ValueError):
                writer.write_rows(0, rows)


def test_stream_writer_errors():
    import io

    layout = png.layout_of("gray", 8, 10, True)
    rows = np.zeros((10, 8), np.uint8)
    for calls in ([(0, rows[:5]), (4, rows[:3])], [(8, rows[:3])], [(0, rows[:0])], [(0, rows[:, :7])], [(-1, rows[:2])]):
        writer = png.StreamWriter(io.BytesIO(), layout)
        with pytest.raises(ValueError):
            for y, part in calls:
                writer.write_rows(y, part)
        with pytest.raises(ValueError):
            writer.write_rows(9, rows[:1])
        with pytest.raises(ValueError):
            writer.close()
    writer = png.StreamWriter(io.BytesIO(), layout)
    writer.write_rows(0, rows[:5])
    with pytest.raises(ValueError, match="missing"):
        writer.close()


def test_sniffing():
    rows = RNG.integers(0, 256, (64, 3000), dtype=np.uint8)
    assert png.sniff(png.encode(rows, png.layout_of("gray", 3000, 64, True)))[0] == "png"
    assert png.sniff(png.encode(rows, png.layout_of("gray", 3000, 64, True)))[1] == 3
    assert png.sniff(jpeg.encode(rows[..., None], "gray", n_workers=2)) == ("jpeg", 375 * 4)
    assert png.sniff(jpeg.encode(rows[..., None], "gray")) == ("jpeg", 0)
    assert png.sniff(b"nothing")[0] == "unknown"


def test_true_colour_gif():
    x = (np.indices((20, 30)).sum(axis=0)[..., None] * [3, 5, 2] % 256).astype(np.uint8)
    for colours, quantizer, drawer in ((256, None, gif.dither), (16, gif.median_cut, gif.nearest)):
        (indices, table), = gif.decode(gif.from_pixels(x, colours, quantizer, drawer))
        shown = table[indices].astype(int)
        assert indices.shape == (20, 30) and np.abs(shown - x).mean() < 40
    with pytest.raises(ValueError):
        gif.from_pixels(x, 0)
