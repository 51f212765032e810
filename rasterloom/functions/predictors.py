"""Row filters, pixel predictors and colour transforms on whole arrays.

Samples are unsigned bytes (or 16-bit words) and wrap.  Every function here is
a projection of a sample and its neighbours, written once for all rows.
"""

from __future__ import annotations

import numpy as np

NONE, SUB, UP, AVERAGE, PAETH = range(5)
# The order in which filters are tried; of equal costs the first stays.
TRIED = (UP, PAETH, NONE, SUB, AVERAGE)
TRIED_DETACHED = (NONE, SUB)


def _neighbours(rows: np.ndarray, bpp: int, above: np.ndarray | None):
    """Left, upper and upper-left samples as wide integers; 0 outside the image."""
    x = rows.astype(np.int16)
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    if above is not None:
        up[0] = above
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    corner[:, bpp:] = up[:, :-bpp]
    return x, left, up, corner


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + up - corner; ties go left, up, corner."""
    da, db, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))


def filtered(rows: np.ndarray, bpp: int, kind: int, above: np.ndarray | None = None) -> np.ndarray:
    """All rows under one filter."""
    x, left, up, corner = _neighbours(rows, bpp, above)
    guess = {NONE: lambda: 0, SUB: lambda: left, UP: lambda: up, AVERAGE: lambda: (left + up) >> 1, PAETH: lambda: paeth(left, up, corner)}[kind]()
    return ((x - guess) & 0xFF).astype(np.uint8)


def signed_cost(residual: np.ndarray) -> np.ndarray:
    """Magnitude of bytes read as signed numbers."""
    r = residual.astype(np.int16)
    return np.minimum(r, 256 - r)


def select_filters(rows: np.ndarray, bpp: int, above: np.ndarray | None = None, detached: bool = False):
    """Per row the filter with the least sum of signed magnitudes.

    Returns ``(kinds, costs, residuals)``.  The first row of a detached band knows
    no row above, so only None and Sub are tried for it.
    """
    each = [filtered(rows, bpp, kind, above) for kind in TRIED]
    costs = np.stack([signed_cost(r).sum(axis=1, dtype=np.int64) for r in each])
    if detached:
        costs[[k for k, kind in enumerate(TRIED) if kind not in TRIED_DETACHED], 0] = np.iinfo(np.int64).max
    best = costs.argmin(axis=0)
    if detached and len(rows):
        own = {kind: costs[TRIED.index(kind), 0] for kind in TRIED_DETACHED}
        best[0] = TRIED.index(min(TRIED_DETACHED, key=own.__getitem__))
    residuals = np.stack(each)[best, np.arange(len(rows))] if len(rows) else rows
    return np.array(TRIED, np.uint8)[best], costs[best, np.arange(len(rows))], residuals


def unfilter(kinds: np.ndarray, residuals: np.ndarray, bpp: int) -> np.ndarray:
    """The rows that a decoder rebuilds from filter kinds and residuals."""
    out = np.zeros_like(residuals)
    n = residuals.shape[1]
    for y, kind in enumerate(kinds):
        row = residuals[y].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(n, np.int32)
        if kind in (NONE, UP):
            out[y] = (row + (up if kind == UP else 0)) & 0xFF
            continue
        got = np.zeros(n + bpp, np.int32)
        over = np.concatenate([np.zeros(bpp, np.int32), up])
        for i in range(0, n, bpp):
            k = slice(i, min(n, i + bpp))
            left, above, corner = got[k], up[k], over[k]
            left, corner = left[:above.size], corner[:above.size]
            guess = left if kind == SUB else (left + above) >> 1 if kind == AVERAGE else paeth(left, above, corner)
            got[bpp + i:bpp + i + above.size] = (row[k] + guess) & 0xFF
        out[y] = got[bpp:]
    return out


def horizontal(rows: np.ndarray, samples: int) -> np.ndarray:
    """Differences to the sample one pixel left, per row; wraps in the type of the rows."""
    out = rows.copy()
    out[:, samples:] -= rows[:, :-samples]
    return out


def undo_horizontal(rows: np.ndarray, samples: int) -> np.ndarray:
    """Running sums along each row, per sample."""
    h, n = rows.shape
    return np.cumsum(rows.reshape(h, n // samples, samples), axis=1, dtype=rows.dtype).reshape(h, n)


def straight_alpha(rgba: np.ndarray) -> np.ndarray:
    """Premultiplied 8-bit RGBA to straight: colour c of alpha a is (c*257*65535 div a*257) >> 8."""
    x = rgba.astype(np.int64)
    a = x[..., 3:]
    colours = np.where(a > 0, (x[..., :3] * 257 * 65535 // np.maximum(a * 257, 1)) >> 8, 0)
    return np.concatenate([colours, a], axis=-1).astype(np.uint8)


def subtract_green(argb: np.ndarray) -> np.ndarray:
    """Red and blue less green; channels last, in the order alpha, red, green, blue."""
    out = argb.copy()
    out[..., 1] -= argb[..., 2]
    out[..., 3] -= argb[..., 2]
    return out


def add_green(argb: np.ndarray) -> np.ndarray:
    out = argb.copy()
    out[..., 1] += argb[..., 2]
    out[..., 3] += argb[..., 2]
    return out


TILE = 16
MODES = 14


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predictions(argb: np.ndarray) -> np.ndarray:
    """All 14 predictions of every pixel of an image ``(h, w, 4)``, modes first.

    The first pixel is predicted opaque black, the first row from the left and
    the first column from above, whatever the mode.  Right of the last column
    stands the first pixel of the row itself.
    """
    h, w, _ = argb.shape
    flat = argb.reshape(-1, 4).astype(np.int16)
    back = lambda n: np.concatenate([np.zeros((min(n, len(flat)), 4), np.int16), flat[:max(0, len(flat) - n)]]) if n else flat
    left, top, corner, right = back(1), back(w), back(w + 1), back(w - 1)
    black = np.zeros_like(flat)
    black[:, 0] = 255
    to_left = np.abs(corner - top).sum(axis=1, keepdims=True)
    to_top = np.abs(corner - left).sum(axis=1, keepdims=True)
    middle = _mean(left, top)
    half = middle - corner
    towards = middle + np.where(half < 0, -((-half) >> 1), half >> 1)
    out = np.stack([
        black, left, top, right, corner,
        _mean(_mean(left, right), top), _mean(left, corner), _mean(left, top), _mean(corner, top), _mean(top, right),
        _mean(_mean(left, corner), _mean(top, right)),
        np.where(to_left < to_top, left, top),
        np.clip(left + top - corner, 0, 255),
        np.clip(towards, 0, 255),
    ]).reshape(MODES, h, w, 4)
    out[:, 0] = left.reshape(h, w, 4)[0]
    out[:, :, 0] = top.reshape(h, w, 4)[:, 0]
    out[:, 0, 0] = (255, 0, 0, 0)
    return out.astype(np.uint8)


def tile_modes(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per 16 x 16 tile the mode of least cost (the first of equals), the costs, and the residual image."""
    h, w, _ = argb.shape
    residuals = argb[None] - predictions(argb)
    costs = signed_cost(residuals).sum(axis=3, dtype=np.int64)
    th, tw = -(-h // TILE), -(-w // TILE)
    grid = np.zeros((MODES, th * TILE, tw * TILE), np.int64)
    grid[:, :h, :w] = costs
    per_tile = grid.reshape(MODES, th, TILE, tw, TILE).sum(axis=(2, 4))
    modes = per_tile.argmin(axis=0)
    each = np.repeat(np.repeat(modes, TILE, axis=0), TILE, axis=1)[:h, :w]
    chosen = np.take_along_axis(residuals, each[None, :, :, None], axis=0)[0]
    return modes.astype(np.uint8), per_tile.min(axis=0), chosen
