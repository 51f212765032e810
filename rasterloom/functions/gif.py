"""GIF files: colour tables, frames, LZW in bands, quantisation and dithering."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

from . import bits, lzw
from .bands import split

BAND_PIXELS, PER_WORKER = 512 << 10, 2


def table_bits(colours: int) -> int:
    """The size field n of a colour table: it has 2 ** (n + 1) entries."""
    return max(0, (max(colours, 1) - 1).bit_length() - 1)


def colour_table(palette) -> bytes:
    """RGB entries, filled up with black to a power of two."""
    raw = b"".join(bytes(c[:3]) for c in palette)
    return raw.ljust(3 * 2 ** (table_bits(len(palette)) + 1), b"\0")


def sub_blocks(stream: bytes) -> bytes:
    """A stream in blocks of at most 255 bytes, and the empty block."""
    return b"".join(bytes([len(stream[a:a + 255])]) + stream[a:a + 255] for a in range(0, len(stream), 255)) + b"\0"


@dataclass(frozen=True)
class Frame:
    """Indices ``(h, w)``, palette, place, delay in hundredths, disposal.

    A palette's first colour without any alpha is the transparent one, unless
    another is named.
    """

    indices: np.ndarray
    palette: tuple
    x: int = 0
    y: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = field(default=None)


def clear_index(frame: Frame) -> int | None:
    """The transparent index of a frame."""
    if frame.transparent is not None:
        return frame.transparent
    return next((i for i, c in enumerate(frame.palette) if len(c) > 3 and c[3] == 0), None)


def shares_table(palette, first, clear: int | None) -> bool:
    """Whether a palette is written as the first one is; its transparent entry does not matter."""
    if len(colour_table(palette)) > len(colour_table(first)):
        return False
    shown = [bytes(c[:3]) for c in first] + [bytes(3)] * (len(palette) - len(first))
    return all(i == clear or bytes(c[:3]) == shown[i] for i, c in enumerate(palette))


def lzw_stream(indices: np.ndarray, literal_width: int, n_workers: int = 1, band_pixels: int = BAND_PIXELS) -> bytes:
    """The stream of a frame, its bands coded apart and spliced."""
    h, w = indices.shape
    cuts = split(h, max(1, band_pixels // w), 1, n_workers, PER_WORKER)
    parts = [lzw.gif_band(indices[a:b].astype(np.uint8).tobytes(), literal_width, a == 0, b == h) for a, b in zip(cuts, cuts[1:])]
    return bits.splice(parts)[0]


def encode(frames: list[Frame], width: int, height: int, loops: int = -1, n_workers: int = 1, band_pixels: int = BAND_PIXELS) -> bytes:
    """A file of one or more frames; the first frame's colours are the global table.

    ``loops`` < 0 plays once without a loop block, 0 for ever.
    """
    if not frames:
        raise ValueError("a file has frames")
    first = frames[0].palette
    out = [b"GIF89a", struct.pack("<2H3B", width, height, 0x80 | table_bits(len(first)), 0, 0), colour_table(first)]
    if len(frames) > 1 and loops >= 0:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        h, w = f.indices.shape
        if not h or not w or f.x < 0 or f.y < 0 or f.x + w > width or f.y + h > height or max(w, h) >= 1 << 16:
            raise ValueError("a frame is empty or leaves the canvas")
        if not 1 <= len(f.palette) <= 256:
            raise ValueError("a palette has 1 to 256 colours")
        clear = clear_index(f)
        if f.delay or f.disposal or clear is not None:
            flags = f.disposal << 2 | (clear is not None)
            out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, clear or 0) + b"\0")
        same = shares_table(f.palette, first, clear)
        out.append(struct.pack("<B4HB", 0x2C, f.x, f.y, w, h, 0 if same else 0x80 | table_bits(len(f.palette))))
        if not same:
            out.append(colour_table(f.palette))
        literal_width = max(2, table_bits(len(f.palette)) + 1)
        out += [bytes([literal_width]), sub_blocks(lzw_stream(f.indices, literal_width, n_workers, band_pixels))]
    return b"".join([*out, b"\x3b"])


def decode(file: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and colour table of each frame (for checks)."""
    flags = file[10]
    at = 13
    table = np.frombuffer(file, np.uint8, 3 * 2 ** ((flags & 7) + 1), at).reshape(-1, 3)
    at += table.size
    out = []
    while file[at] != 0x3B:
        if file[at] == 0x21:
            at += 2
            while file[at]:
                at += file[at] + 1
            at += 1
            continue
        _, _, w, h, flags = struct.unpack_from("<4HB", file, at + 1)
        at += 10
        own = table
        if flags & 0x80:
            own = np.frombuffer(file, np.uint8, 3 * 2 ** ((flags & 7) + 1), at).reshape(-1, 3)
            at += own.size
        literal_width = file[at]
        at += 1
        stream = bytearray()
        while file[at]:
            stream += file[at + 1:at + 1 + file[at]]
            at += file[at] + 1
        at += 1
        out.append((np.frombuffer(lzw.gif_decode(bytes(stream), literal_width), np.uint8).reshape(h, w), own))
    return out


# --- quantisation


def distances(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Sums over channels of squared 16-bit differences, each a quarter."""
    d = pixels[..., None, :].astype(np.int64) - palette.astype(np.int64)
    return ((d * d) >> 2).sum(axis=-1)


def nearest(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The index of the nearest colour, the first of equals; 16-bit channels."""
    return distances(pixels, palette).argmin(axis=-1).astype(np.uint8)


LANES, AT_ONCE = 512, 1 << 17


def dither(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Floyd-Steinberg: 7/16 of the error right, 3, 5 and 1 of it below; 16-bit channels.

    Errors are held in sixteenths and divided towards zero when they are used.
    """
    return dither_all([pixels], palette)[0]


def dither_all(pictures: list[np.ndarray], palette: np.ndarray) -> list[np.ndarray]:
    """``dither`` of pictures ``(h, w, c)`` of one width, each by itself, all at once.

    A pixel needs those left of it and, in the row above, up to the one to its right:
    what lies on x + 2y = t needs only earlier t and goes in one step.  Pictures stand
    below one another in lanes that run side by side; a picture takes no error from the
    one above it.
    """
    colours = np.asarray(palette, np.int64)
    told = np.flatnonzero((colours != colours[0]).any(axis=0))  # a channel alike in all colours decides nothing
    width, heights = pictures[0].shape[1], [len(p) for p in pictures]
    if not len(told) or not width or not max(heights):
        return [np.zeros(p.shape[:2], np.uint8) for p in pictures]
    for values in (colours, *pictures):
        if values.size and (values.min() < 0 or values.max() > 65535):
            raise ValueError("channels have 16 bits")
    # lanes of about the same height, the highest pictures dealt first
    ends = [(0, lane) for lane in range(max(1, min(LANES, len(pictures), sum(heights) // max(heights))))]
    place = {}
    for i in sorted(range(len(pictures)), key=lambda i: -heights[i]):
        y, lane = heapq.heappop(ends)
        place[i] = (lane, y)
        heapq.heappush(ends, (y + heights[i], lane))
    # a slot takes every slots-th row, and rests at least a step between two rows: the errors there are 0
    lanes, slots = len(ends), width // 2 + 1
    period, rounds = 2 * slots, -(-max(y for y, _ in ends) // slots)
    stacked = np.zeros((len(told), lanes, rounds * slots, width), np.uint16)
    goes_on = np.ones((rounds * slots, lanes), np.int32)
    for i, (lane, y) in place.items():
        stacked[:, lane, y:y + heights[i]] = np.moveaxis(pictures[i][..., told], -1, 0)
        goes_on[y:y + 1, lane] = 0
    steps = period * rounds + 2 * (slots - 1)
    entering = np.zeros((steps, len(told), slots, lanes), np.uint16)
    for s in range(slots):
        own = entering[2 * s:2 * s + period * rounds, :, s].reshape(rounds, period, len(told), lanes)
        own[:, :width] = stacked[:, :, s::slots].transpose(2, 3, 0, 1)
    del stacked
    chosen = _wavefront(entering, colours[:, told], goes_on, width)
    drawn = np.zeros((lanes, rounds, slots, width), np.uint8)
    for s in range(slots):
        drawn[:, :, s] = chosen[2 * s:2 * s + period * rounds, s].reshape(rounds, period, lanes)[:, :width].transpose(2, 0, 1)
    drawn = drawn.reshape(lanes, rounds * slots, width)
    return [drawn[place[i][0], place[i][1]:place[i][1] + h] for i, h in enumerate(heights)]


def _wavefront(entering: np.ndarray, colours: np.ndarray, goes_on: np.ndarray, width: int) -> np.ndarray:
    """Indices ``(step, slot, lane)`` of the pixels ``(step, channel, slot, lane)`` that come in each step."""
    steps, channels, slots, lanes = entering.shape
    period = 2 * slots
    out = np.zeros((steps, slots, lanes), np.uint8)
    # squares of 16-bit differences, a quarter of them and sums of four of these are 32-bit numbers
    kind = np.uint32 if channels <= 4 else np.uint64
    table = np.ascontiguousarray(colours.T, np.int32)
    shown = table.astype(kind)[:, :, None, None]
    some = min(255, max(1, AT_ONCE // (slots * lanes)))
    groups = [(a, min(len(colours), a + some)) for a in range(0, len(colours), some)]
    difference = np.empty((min(some, len(colours)), slots, lanes), kind)
    cost = np.empty_like(difference)
    last, before, earlier = np.zeros((3, channels, slots, lanes), np.int32)
    below = np.zeros((slots, lanes), np.int32)
    over, carried = np.empty((2, channels, slots, lanes), np.int32)
    for t in range(steps):
        if t % 2 == 0 and t // 2 < len(goes_on):
            below[t // 2 % slots] = goes_on[t // 2]
        # the row above is in the slot before, two pixels ahead
        over[:] = last * 3 + before * 5 + earlier
        carried[:, 1:], carried[:, 0] = over[:, :-1], over[:, -1]
        carried *= below
        carried += last * 7
        carried += carried >> 31 & 15
        carried >>= 4
        carried += entering[t]
        np.clip(carried, 0, 65535, out=carried)
        value = carried.astype(kind)
        index, least = out[t], None
        for a, b in groups:
            d, total = difference[:b - a], cost[:b - a]
            for c in range(channels):
                into = d if c else total
                np.subtract(value[c], shown[c, a:b], out=into)
                np.multiply(into, into, out=into)
                np.right_shift(into, 2, out=into)
                if c:
                    np.add(total, d, out=total)
            found = total.min(axis=0)
            # of equals the first: the highest of ranks that fall
            rank = np.arange(b - a, 0, -1, np.uint8)[:, None, None]
            first = np.uint8(b & 255) - ((total == found).view(np.uint8) * rank).max(axis=0)
            if least is None:
                least, index[:] = found, first
            else:
                better = found < least
                index[better] = first[better]
                np.minimum(least, found, out=least)
        earlier, before, last = before, last, earlier
        np.subtract(carried, table[:, index], out=last)
        phase = width + (t - width) % 2
        if phase < period:  # the slot that rests
            last[:, (t - phase) // 2 % slots] = 0
    return out


def plan9_palette() -> np.ndarray:
    """256 colours: a 4 x 4 x 4 cube of hues with four shades of each.

    By rule: for each r, g, b in 0..3 and shade v, the colour's largest component
    is scaled to one of the levels its cell holds; greys are an even ramp.
    """
    out = []
    for r in range(4):
        for v in range(4):
            for g in range(4):
                for b in range(4):
                    top = max(r, g, b)
                    if top == 0:
                        out.append((17 * v,) * 3)
                    else:
                        level = 17 * (4 * top + v)
                        out.append(tuple(x * level // top for x in (r, g, b)))
    return np.array(out, np.int64)


def median_cut(pixels: np.ndarray, colours: int) -> np.ndarray:
    """A palette by halving the widest box of colours at its median."""
    boxes = [np.unique(pixels.reshape(-1, pixels.shape[-1]), axis=0)]
    while len(boxes) < colours:
        spans = [int(np.ptp(b, axis=0).max()) if len(b) > 1 else -1 for b in boxes]
        k = int(np.argmax(spans))
        if spans[k] <= 0:
            break
        box = boxes.pop(k)
        axis = int(np.ptp(box, axis=0).argmax())
        box = box[box[:, axis].argsort(kind="stable")]
        boxes += [box[:len(box) // 2], box[len(box) // 2:]]
    return np.array([b.mean(axis=0).round() for b in boxes]).astype(np.int64)


def from_pixels(pixels: np.ndarray, colours: int = 256, quantizer=None, drawer=dither, n_workers: int = 1) -> bytes:
    """A file of an image of 8-bit channels ``(h, w, 3)``.

    ``quantizer`` makes a palette of an image (default: the fixed one, cut to the
    number asked for), ``drawer`` indices of an image and a palette; both see
    16-bit channels.
    """
    if not 1 <= colours <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    palette = quantizer(pixels, colours) if quantizer else plan9_palette()[:colours]
    wide = lambda x: np.concatenate([x.astype(np.int64), np.full((*x.shape[:-1], 1), 255)], axis=-1) * 257
    indices = drawer(wide(pixels), wide(palette))
    frame = Frame(indices, tuple((*map(int, c), 255) for c in palette))
    return encode([frame], pixels.shape[1], pixels.shape[0], n_workers=n_workers)
