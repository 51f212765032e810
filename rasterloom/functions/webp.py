"""WebP files: one lossless image, or an animation of them."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import vp8l
from .bands import split

BAND_PIXELS, PER_WORKER = 64 << 10, 2


def chunk_size(n: int) -> int:
    """Bytes of a chunk with n bytes of data: a header, and even padding."""
    return 8 + n + (n & 1)


def chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)


def riff(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def put24(v: int) -> bytes:
    return struct.pack("<I", v)[:3]


def image_stream(argb: np.ndarray, n_workers: int = 1) -> bytes:
    h, w, _ = argb.shape
    if not 1 <= w <= 1 << 14 or not 1 <= h <= 1 << 14:
        raise ValueError("the size of an image is from 1 to 16384 a side")
    return vp8l.encode(argb, split(h, max(1, BAND_PIXELS // w), 1, n_workers, PER_WORKER))


SMALL = 1 << 14  # bytes: streams of the last 1024 pictures of at most this size are kept, 32 MB with the pictures


@lru_cache(1024)
def _small_stream(raw: bytes, height: int, width: int, n_workers: int) -> bytes:
    return image_stream(np.frombuffer(raw, np.uint8).reshape(height, width, 4), n_workers)


def frame_streams(pictures: list[np.ndarray], n_workers: int = 1) -> list[bytes]:
    """The streams of an animation's pictures; equal pictures have one, which is made once."""
    by_object, by_pixels, out = {}, {}, []
    for argb in pictures:
        stream = by_object.get(id(argb))
        if stream is None:
            h, w, _ = argb.shape
            if argb.dtype == np.uint8 and argb.nbytes <= SMALL:
                stream = _small_stream(argb.tobytes(), h, w, n_workers)
            else:
                key = argb.shape, argb.dtype.str, hashlib.sha256(np.ascontiguousarray(argb)).digest()
                if key not in by_pixels:
                    by_pixels[key] = image_stream(argb, n_workers)
                stream = by_pixels[key]
            by_object[id(argb)] = stream
        out.append(stream)
    return out


def encode(argb: np.ndarray, n_workers: int = 1) -> bytes:
    """The file of one image ``(h, w, 4)`` in alpha, red, green, blue."""
    return riff(chunk(b"VP8L", image_stream(argb, n_workers)))


@dataclass(frozen=True)
class Frame:
    argb: np.ndarray
    x: int = 0
    y: int = 0
    duration_ms: int = 0
    blend: bool = False
    dispose: bool = False


def canvas(frames: list[Frame], width: int = 0, height: int = 0) -> tuple[int, int]:
    """The canvas: sides left at 0 reach to the farthest frame."""
    width = width or max((f.x + f.argb.shape[1] for f in frames), default=0)
    height = height or max((f.y + f.argb.shape[0] for f in frames), default=0)
    if not (0 < width <= 1 << 24 and 0 < height <= 1 << 24 and width * height < 1 << 32):
        raise ValueError("the canvas is out of range")
    return width, height


def check_frames(frames: list[Frame], width: int, height: int, loops: int) -> None:
    if not frames:
        raise ValueError("an animation has frames")
    if not 0 <= loops <= 0xFFFF:
        raise ValueError("the loop count is from 0 to 65535")
    for f in frames:
        h, w, _ = f.argb.shape
        if f.duration_ms < 0:
            raise ValueError("a frame lasts no negative time")
        if f.x < 0 or f.y < 0 or f.x % 2 or f.y % 2:
            raise ValueError("frames start at even coordinates from 0")
        if not w or not h or f.x + w > width or f.y + h > height or max(w, h) > 1 << 14:
            raise ValueError("a frame is empty, too large or leaves the canvas")


def encode_animation(frames: list[Frame], width: int = 0, height: int = 0, loops: int = 0, background: tuple[int, int, int, int] = (0, 0, 0, 0), n_workers: int = 1) -> bytes:
    """An animated file; the background is red, green, blue, alpha."""
    if not frames:
        raise ValueError("an animation has frames")
    width, height = canvas(frames, width, height)
    check_frames(frames, width, height, loops)
    alpha = any((x[..., 0] != 255).any() for x in {id(f.argb): f.argb for f in frames}.values())
    r, g, b, a = background
    body = [chunk(b"VP8X", bytes([0x02 | (0x10 if alpha else 0), 0, 0, 0]) + put24(width - 1) + put24(height - 1))]
    body.append(chunk(b"ANIM", bytes([b, g, r, a]) + struct.pack("<H", loops)))
    for f, stream in zip(frames, frame_streams([f.argb for f in frames], n_workers)):
        h, w, _ = f.argb.shape
        head = put24(f.x // 2) + put24(f.y // 2) + put24(w - 1) + put24(h - 1) + put24(min(f.duration_ms, (1 << 24) - 1))
        flags = (0 if f.blend else 0x02) | (0x01 if f.dispose else 0)
        body.append(chunk(b"ANMF", head + bytes([flags]) + chunk(b"VP8L", stream)))
    return riff(b"".join(body))


def parse(data: bytes) -> list[tuple[str, bytes]]:
    """Chunks of a file (or of a frame's data)."""
    if data[:4] == b"RIFF":
        if struct.unpack_from("<I", data, 4)[0] + 8 != len(data) or data[8:12] != b"WEBP":
            raise ValueError("the RIFF header does not fit")
        data = data[12:]
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at + 4)
        out.append((data[at:at + 4].decode("latin-1"), data[at + 8:at + 8 + n]))
        at += chunk_size(n)
    return out
