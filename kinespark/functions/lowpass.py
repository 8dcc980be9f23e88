"""Second-order Butterworth low-pass, applied forward and backward (zero phase)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = 9  # rows of odd reflection at each end: 3 × the 3 filter coefficients
NEGLIGIBLE = 1e-17  # taps below this share of the response are left out


def coefficients(cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """b and a of the order-2 filter from the bilinear transform with frequency pre-warping."""
    k = math.tan(math.pi * cutoff / fs)
    scale = 1 + math.sqrt(2) * k + k * k
    b = np.array([1.0, 2.0, 1.0]) * k * k / scale
    a = np.array([1.0, 2 * (k * k - 1) / scale, (1 - math.sqrt(2) * k + k * k) / scale])
    return b, a


def impulse_response(cutoff: float = 6.0, fs: float = 100.0) -> np.ndarray:
    """The filter's response to a unit impulse, cut where it no longer matters."""
    b, a = coefficients(cutoff, fs)
    radius = math.sqrt(a[2])
    length = max(32, math.ceil(math.log(NEGLIGIBLE) / math.log(radius)) + 8)
    h = np.zeros(length)
    for i in range(length):
        h[i] = b[i] if i < 3 else 0.0
        if i >= 1:
            h[i] -= a[1] * h[i - 1]
        if i >= 2:
            h[i] -= a[2] * h[i - 2]
    return h


def _one_way(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Convolve, as if the first value had been there forever."""
    y = np.convolve(x, h)[: len(x)]
    head = min(len(h), len(x))
    y[:head] += (1.0 - np.cumsum(h)[:head]) * x[0]
    return y


def smooth(x: np.ndarray, h: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
    """Filter one stretch of a series forward and backward.

    Ends of the series are extended by odd reflection; at a cut inside the series the caller brings
    at least ``len(h)`` more rows, whose own output is not used.
    """
    head = 2 * x[0] - x[PAD:0:-1] if at_start else x[:0]
    tail = 2 * x[-1] - x[-2 : -PAD - 2 : -1] if at_end else x[:0]
    extended = np.concatenate([head, x, tail])
    y = _one_way(_one_way(extended, h)[::-1], h)[::-1]
    return y[len(head) : len(head) + len(x)]


def smooth_udf(cutoff: float, fs: float):
    """Column function over one block per row: (values, at_start, at_end) → filtered values."""
    h = impulse_response(cutoff, fs)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(values: pd.Series, at_start: pd.Series, at_end: pd.Series) -> pd.Series:
        return pd.Series([smooth(np.asarray(v), h, s, e) for v, s, e in zip(values, at_start, at_end)])

    return apply
