"""Bands of rows: the rule that cuts an image's height."""

from __future__ import annotations

import os


def workers(n: int) -> int:
    """The number asked for, or as many as there are processors."""
    return n if n > 0 else os.cpu_count() or 1


def split(height: int, least: int, align: int, n_workers: int, per_worker: int) -> list[int]:
    """First rows of the bands, and the height.

    As many bands as workers ask for and ``least`` rows (at least ``align``) allow;
    the i-th of n begins at i * height / n, rounded down to ``align``; empty bands
    are left out.  One worker gets one band.
    """
    n = 1 if n_workers <= 1 else max(1, min(n_workers * per_worker, height // max(1, least, align)))
    cuts = {i * height // n // align * align for i in range(n)}
    return sorted({0} | {c for c in cuts if 0 < c < height}) + [height]
