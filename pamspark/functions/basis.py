"""Cubic B-splines on evenly spaced knots, as Spark columns and as numpy arrays.

The knot range is widened by a thousandth on either side; ``k`` functions use ``k - 3`` inner
intervals. With r the distance from a function's centre in knot steps, its value is
``((2 - r)+^3 - 4 (1 - r)+^3) / 6``, the cubic B-spline without case distinctions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDEN = 0.001


def _steps(x, lo, hi, k: int):
    """Position of x in knot intervals, 0 at the left end of the widened range."""
    span = hi - lo
    return (x - (lo - WIDEN * span)) / (span * (1 + 2 * WIDEN) / (k - 3))


def bspline_columns(x: Column, lo, hi, k: int) -> list[Column]:
    """The ``k`` basis functions of ``x`` as column expressions; ``lo`` and ``hi`` may be columns."""
    u = _steps(x, lo, hi, k)
    out = []
    for i in range(k):
        r = F.abs(u - (i - 1))
        wide, narrow = F.greatest(2 - r, F.lit(0.0)), F.greatest(1 - r, F.lit(0.0))
        out.append((wide * wide * wide - 4 * narrow * narrow * narrow) / 6)
    return out


def bspline_values(x, lo: float, hi: float, k: int) -> np.ndarray:
    """The same basis for an array: shape (len(x), k)."""
    r = np.abs(_steps(np.asarray(x, dtype=float), lo, hi, k)[:, None] - (np.arange(k) - 1))
    wide, narrow = np.maximum(2 - r, 0), np.maximum(1 - r, 0)
    return (wide * wide * wide - 4 * narrow * narrow * narrow) / 6


def difference_penalty(k: int, order: int) -> np.ndarray:
    """Squared differences of neighbouring coefficients."""
    d = np.diff(np.eye(k), order, axis=0)
    return d.T @ d


def centring(mean: np.ndarray) -> np.ndarray:
    """Columns spanning the coefficients whose smooth has mean zero: shape (k, k - 1)."""
    q, _ = np.linalg.qr(np.asarray(mean, dtype=float)[:, None], mode="complete")
    return q[:, 1:]
