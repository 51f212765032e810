"""PNG and APNG files: chunks, schema of pixels, palettes, rows, bands."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from . import deflate
from .bands import split
from .predictors import select_filters, straight_alpha

SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY, RGB, PALETTE, RGBA = 0, 2, 3, 6
CHANNELS = {GRAY: 1, RGB: 3, PALETTE: 1, RGBA: 4}
IDAT_BYTES = 64 << 10
BAND_BYTES, BAND_ROWS, PER_WORKER = 512 << 10, 16, 2


def chunk(kind: bytes, data: bytes = b"") -> bytes:
    """Length, type, data and the CRC-32 of type and data."""
    if len(data) >= 1 << 31:
        raise ValueError("a chunk holds less than 2**31 bytes")
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def chunks(file: bytes) -> list[tuple[str, bytes]]:
    """Types and data of a file's chunks, CRCs checked."""
    if not file.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, out = len(SIGNATURE), []
    while at < len(file):
        (n,) = struct.unpack_from(">I", file, at)
        kind, data = file[at + 4:at + 8], file[at + 8:at + 8 + n]
        if struct.unpack_from(">I", file, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"the CRC of {kind!r} is wrong")
        out.append((kind.decode("latin-1"), data))
        at += 12 + n
    return out


@dataclass(frozen=True)
class Layout:
    """How pixels are stored: colour type, depth, and the palette if there is one."""

    width: int
    height: int
    colour: int
    depth: int
    palette: tuple[tuple[int, int, int, int], ...] = ()

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0 or self.width >= 1 << 32 or self.height >= 1 << 32:
            raise ValueError("the size of an image is from 1 to 2**32 - 1 a side")
        if self.colour == PALETTE and not 1 <= len(self.palette) <= 256:
            raise ValueError("a palette has 1 to 256 colours")
        if (self.row_bytes + 1) * self.height >= 1 << 63:
            raise ValueError("the filtered image is too large")

    @property
    def row_bytes(self) -> int:
        return (self.width * CHANNELS[self.colour] * self.depth + 7) // 8

    @property
    def bpp(self) -> int:
        return max(1, CHANNELS[self.colour] * self.depth // 8)


def palette_depth(colours: int) -> int:
    """Bits of an index into so many colours."""
    if not 1 <= colours <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    return 1 if colours <= 2 else 2 if colours <= 4 else 4 if colours <= 16 else 8


def layout_of(model: str, width: int, height: int, opaque: bool, palette=()) -> Layout:
    """The layout for a colour model: alpha is dropped where all pixels are opaque."""
    if model == "paletted":
        return Layout(width, height, PALETTE, palette_depth(len(palette)), tuple(map(tuple, palette)))
    if model in ("gray", "gray16"):
        return Layout(width, height, GRAY, 16 if model == "gray16" else 8)
    return Layout(width, height, RGB if opaque else RGBA, 16 if model in ("rgba64", "nrgba64") else 8)


def palette_tables(palette) -> tuple[bytes, bytes]:
    """RGB triples, and alphas up to the last that is not opaque."""
    rgb = b"".join(bytes(c[:3]) for c in palette)
    alphas = bytes(c[3] for c in palette)
    return rgb, alphas.rstrip(b"\xff")


def pack_indices(indices: np.ndarray, depth: int) -> np.ndarray:
    """Rows of palette indices packed from the high bits."""
    if depth == 8:
        return indices.astype(np.uint8)
    h, w = indices.shape
    per = 8 // depth
    x = np.pad(indices.astype(np.uint8), ((0, 0), (0, -w % per))).reshape(h, -1, per)
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return np.bitwise_or.reduce(x << shifts, axis=2).astype(np.uint8)


def scanlines(pixels: np.ndarray, model: str, layout: Layout) -> np.ndarray:
    """Rows of bytes of an image's pixels ``(h, w, channels)`` in its layout."""
    h, w = pixels.shape[:2]
    if layout.colour == PALETTE:
        return pack_indices(pixels.reshape(h, w), layout.depth)
    if model == "rgba" and layout.colour == RGBA:
        pixels = straight_alpha(pixels)
    if layout.colour == RGB:
        pixels = pixels[..., :3]
    if layout.depth == 16:
        return np.ascontiguousarray(pixels.reshape(h, -1).astype(">u2")).view(np.uint8)
    return np.ascontiguousarray(pixels.reshape(h, -1).astype(np.uint8))


@dataclass
class Band:
    """Filtered, deflated rows, with what is needed to join them."""

    first: int
    stop: int
    data: bytes
    adler: int
    length: int


@dataclass(frozen=True)
class Options:
    """Encoder options: level (0 to 9, or -1), the fast mode, a compressor, workers."""

    level: int = 6
    fast: bool = False
    compressor: str = "zlib"
    workers: int = 1
    band_bytes: int = BAND_BYTES
    band_rows: int = BAND_ROWS


def filter_rows(rows: np.ndarray, layout: Layout, options: Options, above: np.ndarray | None = None, detached: bool = False) -> bytes:
    """Each row as its filter kind and its residual."""
    from .predictors import NONE, SUB, UP, filtered

    if layout.colour == PALETTE or options.level == 0 and not options.fast:
        kinds, residuals = np.full(len(rows), NONE, np.uint8), rows
    elif options.fast:
        kinds, residuals = np.full(len(rows), UP, np.uint8), filtered(rows, layout.bpp, UP, above)
        if detached and len(rows):
            kinds[0], residuals[0] = SUB, filtered(rows[:1], layout.bpp, SUB)[0]
    else:
        kinds, _, residuals = select_filters(rows, layout.bpp, above, detached)
    return np.concatenate([kinds[:, None], residuals], axis=1).tobytes()


def encode_band(rows: np.ndarray, first: int, stop: int, layout: Layout, options: Options, detached: bool = False) -> Band:
    """Rows first to stop of an image, from the rows themselves and those before them.

    A band sees the row above it, to filter by, and what the 32 KiB before it
    come out as, to refer back to.
    """
    halo = 0 if detached else -(-deflate.WINDOW // (layout.row_bytes + 1))
    start = 0 if detached else max(0, first - halo)
    above = rows[start - 1] if start else None
    whole = filter_rows(rows[start:stop], layout, options, above, detached)
    cut = (first - start) * (layout.row_bytes + 1)
    before, data = whole[:cut], whole[cut:]
    last = stop == layout.height and not detached
    if options.fast:
        raw = deflate.fast_deflate(data, layout.bpp, last)
    else:
        raw = deflate.deflate_band(data, before, last, options.level, deflate.COMPRESSORS[options.compressor])
    return Band(first, stop, raw, zlib.adler32(data), len(data))


def image_bands(layout: Layout, options: Options) -> list[int]:
    """First rows of the bands, and the height."""
    least = max(options.band_rows, -(-options.band_bytes // layout.row_bytes))
    return split(layout.height, least, 1, options.workers, PER_WORKER)


def header_chunks(layout: Layout) -> bytes:
    out = chunk(b"IHDR", struct.pack(">2I5B", layout.width, layout.height, layout.depth, layout.colour, 0, 0, 0))
    return out


def palette_chunks(layout: Layout) -> bytes:
    if layout.colour != PALETTE:
        return b""
    rgb, alphas = palette_tables(layout.palette)
    return chunk(b"PLTE", rgb) + (chunk(b"tRNS", alphas) if alphas else b"")


def idat(stream: bytes, size: int = IDAT_BYTES) -> bytes:
    """A stream in chunks of a bounded size."""
    return b"".join(chunk(b"IDAT", stream[a:a + size]) for a in range(0, len(stream), size))


def zlib_stream(rows: np.ndarray, layout: Layout, options: Options) -> bytes:
    cuts = image_bands(layout, options)
    bands = [encode_band(rows, a, b, layout, options) for a, b in zip(cuts, cuts[1:])]
    return deflate.join_bands([(b.data, b.adler, b.length) for b in bands], 1 if options.fast else options.level)


def encode(rows: np.ndarray, layout: Layout, options: Options = Options()) -> bytes:
    """The file of an image given by its rows of bytes."""
    return SIGNATURE + header_chunks(layout) + palette_chunks(layout) + idat(zlib_stream(rows, layout, options)) + chunk(b"IEND")


def decode_rows(stream: bytes, layout: Layout) -> np.ndarray:
    """The rows of bytes in a zlib stream of filtered rows."""
    from .predictors import unfilter

    whole = np.frombuffer(zlib.decompress(stream), np.uint8).reshape(layout.height, layout.row_bytes + 1)
    return unfilter(whole[:, 0], whole[:, 1:], layout.bpp)


def read_layout(file: bytes) -> Layout:
    """The layout that a file's header and palette say."""
    parts = dict(chunks(file))
    w, h, depth, colour = struct.unpack_from(">2I2B", parts["IHDR"])
    rgb, alphas = parts.get("PLTE", b""), parts.get("tRNS", b"")
    n = len(rgb) // 3
    alphas += b"\xff" * (n - len(alphas))
    return Layout(w, h, colour, depth, tuple((*rgb[3 * i:3 * i + 3], alphas[i]) for i in range(n)))


# --- animation


@dataclass(frozen=True)
class Frame:
    """One frame: pixels, where they stand, how long, and how they go."""

    pixels: np.ndarray
    model: str = "nrgba"
    x: int = 0
    y: int = 0
    delay_ms: float = 0
    dispose: int = 0
    blend: int = 0
    palette: tuple = field(default=())


def delay_fraction(ns: int) -> tuple[int, int]:
    """A delay as 16-bit numerator and denominator: milliseconds, else hundredths, else seconds."""
    ns = max(0, ns)
    for unit, per in ((1_000_000, 1000), (10_000_000, 100)):
        if ns // unit <= 0xFFFF:
            return ns // unit, per
    return min(ns // 1_000_000_000, 0xFFFF), 1


def common_layout(frames: list[Frame], width: int, height: int) -> list[Layout]:
    """One colour type for all frames: a shared palette, else RGB or RGBA, 16 bits if all are."""
    own = [layout_of(f.model, f.pixels.shape[1], f.pixels.shape[0], opaque(f), f.palette) for f in frames]
    tables = {palette_tables(x.palette) for x in own if x.colour == PALETTE}
    shared = all(x.colour == PALETTE for x in own) and len(tables) == 1
    if shared:
        return own
    plain = all(opaque(f) for f in frames)
    deep = all(x.depth == 16 for x in own)
    return [Layout(x.width, x.height, RGB if plain else RGBA, 16 if deep else 8) for x in own]


def opaque(frame: Frame) -> bool:
    """Whether no pixel (no palette colour) is see-through."""
    if frame.model == "paletted":
        return all(c[3] == 255 for c in frame.palette)
    if frame.model in ("gray", "gray16"):
        return True
    return bool((frame.pixels[..., 3] == (65535 if frame.model.endswith("64") else 255)).all())


def _as_straight(frame: Frame, layout: Layout) -> np.ndarray:
    """A frame's rows in the common layout."""
    if layout.colour == PALETTE:
        return scanlines(frame.pixels, frame.model, layout)
    x = frame.pixels
    if frame.model == "paletted":
        x = np.array(frame.palette, np.uint16)[x.reshape(x.shape[:2])]
    elif frame.model in ("gray", "gray16"):
        x = np.repeat(x.reshape(*x.shape[:2], 1), 4, axis=2)
        x[..., 3] = 65535 if frame.model == "gray16" else 255
    elif frame.model == "rgba":
        x = straight_alpha(x)
    if frame.model in ("gray16", "nrgba64", "rgba64") and layout.depth == 8:
        x = x >> 8
    return scanlines(x, "nrgba64" if layout.depth == 16 else "nrgba", layout)


def check_frames(frames: list[Frame], loops: int) -> None:
    if not frames:
        raise ValueError("an animation has frames")
    if not 0 <= loops < 1 << 31:
        raise ValueError("the loop count is from 0 to 2**31 - 1")
    h, w = frames[0].pixels.shape[:2]
    for k, f in enumerate(frames):
        if f.pixels is None or f.dispose not in (0, 1, 2) or f.blend not in (0, 1):
            raise ValueError(f"frame {k}: no pixels, or an unknown dispose or blend code")
        fh, fw = f.pixels.shape[:2]
        if not fw or not fh or f.x < 0 or f.y < 0 or f.x + fw > w or f.y + fh > h:
            raise ValueError(f"frame {k} is empty or leaves the canvas")
    if frames[0].x or frames[0].y:
        raise ValueError("the first frame starts at (0, 0)")


def encode_animation(frames: list[Frame], loops: int = 0, options: Options = Options()) -> bytes:
    """An animated file; decoders that know no animation show the first frame."""
    check_frames(frames, loops)
    h, w = frames[0].pixels.shape[:2]
    layouts = common_layout(frames, w, h)
    out = [SIGNATURE, header_chunks(layouts[0]), chunk(b"acTL", struct.pack(">2I", len(frames), loops)), palette_chunks(layouts[0])]
    serial = 0
    for k, (f, layout) in enumerate(zip(frames, layouts)):
        num, den = delay_fraction(int(f.delay_ms * 1_000_000))
        out.append(chunk(b"fcTL", struct.pack(">5I2H2B", serial, layout.width, layout.height, f.x, f.y, num, den, f.dispose, f.blend)))
        serial += 1
        stream = zlib_stream(_as_straight(f, layout), layout, options)
        if k == 0:
            out.append(idat(stream))
            continue
        for a in range(0, len(stream), IDAT_BYTES):
            out.append(chunk(b"fdAT", struct.pack(">I", serial) + stream[a:a + IDAT_BYTES]))
            serial += 1
    return b"".join([*out, chunk(b"IEND")])


# --- bands that know nothing of each other


EMPTY_FINAL = b"\x03\x00"  # a last deflate block with nothing in it


def encode_detached(rows: np.ndarray, layout: Layout, options: Options = Options()) -> Band:
    """A stretch of rows encoded without any other: its first row sees no row above.

    Long stretches are cut into bands, of which only the first is detached.
    """
    own = Layout(layout.width, len(rows), layout.colour, layout.depth, layout.palette)
    cuts = image_bands(own, options)
    open_ended = Layout(layout.width, len(rows) + 1, layout.colour, layout.depth, layout.palette)  # none of them is the last
    made = [encode_band(rows, a, b, open_ended, options, detached=a == 0) for a, b in zip(cuts, cuts[1:])]
    adler = 1
    for b in made:
        adler = deflate.adler_combine(adler, b.adler, b.length)
    return Band(0, len(rows), b"".join(b.data for b in made), adler, sum(b.length for b in made))


def assemble(layout: Layout, bands: list[tuple[bytes, int, int]], level: int = 6) -> bytes:
    """The file of detached bands ``(data, adler, length)`` in order."""
    total = 1
    for _, adler, n in bands:
        total = deflate.adler_combine(total, adler, n)
    stream = deflate.zlib_header(level) + b"".join(d for d, _, _ in bands) + EMPTY_FINAL + struct.pack(">I", total)
    return SIGNATURE + header_chunks(layout) + palette_chunks(layout) + idat(stream) + chunk(b"IEND")


class StreamWriter:
    """A PNG written by rows: bands in any order, emitted as soon as all before them are.

    The size and kind of pixels are fixed when it is opened.  A band that leaves
    the image or meets rows that were claimed is an error, after which no more is
    taken; closing before all rows are there is one, too.
    """

    def __init__(self, out, layout: Layout, options: Options = Options()):
        from ..streaming.bands_stream import Order

        if layout.width >= 1 << 31 or layout.height >= 1 << 31:
            raise ValueError("the size of a stream is below 2**31 a side")
        self.out, self.layout, self.options = out, layout, options
        self.order, self.adler, self.closed = Order(), 1, False
        self.sums: dict[int, tuple[int, int]] = {}
        out.write(SIGNATURE + header_chunks(layout) + palette_chunks(layout))
        self.head = deflate.zlib_header(1 if options.fast else options.level)

    def write_rows(self, y0: int, rows: np.ndarray) -> None:
        if self.closed:
            raise ValueError("the stream is closed")
        y1 = y0 + len(rows)
        wrong = "rows of another length" if rows.ndim != 2 or rows.shape[1] != self.layout.row_bytes else self.order.claim(y0, y1, self.layout.height)
        if wrong:
            self.order.error = self.order.error or wrong
            raise ValueError(wrong)
        band = encode_detached(rows, self.layout, self.options)
        self.sums[y0] = band.adler, band.length
        for _, start, _, data, _ in self.order.add(y0, y1, self.layout.height, band.data):
            adler, n = self.sums.pop(start)
            self.adler = deflate.adler_combine(self.adler, adler, n)
            self.out.write(idat(self.head + data))
            self.head = b""

    def close(self) -> None:
        if self.closed or self.order.error:
            raise ValueError(self.order.error or "the stream is closed")
        self.closed = True
        if self.order.frontier != self.layout.height:
            raise ValueError(f"rows are missing from {self.order.frontier}")
        self.out.write(idat(self.head + EMPTY_FINAL + struct.pack(">I", self.adler)) + chunk(b"IEND"))


def sniff(file: bytes) -> tuple[str, int]:
    """What a file is, and into how many parts it was cut: IDAT chunks, or restart intervals (0: none)."""
    if file.startswith(SIGNATURE):
        return "png", sum(k == "IDAT" for k, _ in chunks(file))
    if file[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(file) and file[at] == 0xFF and file[at + 1] != 0xDA:
            (n,) = struct.unpack_from(">H", file, at + 2)
            if file[at + 1] == 0xDD:
                return "jpeg", struct.unpack_from(">H", file, at + 4)[0]
            at += 2 + n
        return "jpeg", 0
    kinds = {b"GIF8": "gif", b"II*\0": "tiff", b"RIFF": "webp"}
    return kinds.get(file[:4], "unknown"), 0
