"""Power spectrum of one window and the measures taken from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_GUARD = 1e-10  # added inside the logarithm of the spectral entropy


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(values: pd.Series) -> pd.Series:
    """|FFT|² of each array for the bins 0 … n//2 − 1: mean kept, Nyquist dropped, no taper."""
    return pd.Series([np.abs(np.fft.fft(v)[: len(v) // 2]) ** 2 for v in values])


def window_measures(values: str | Column, fs: float, low: float, high: float) -> Column:
    """Struct (dominant_bin, spectral_entropy, band_energy) of each array of samples.

    The spectrum itself never leaves the kernel. The dominant bin is the first of equal ones; the
    entropy is −Σ p·log2(p + guard), NULL for a window without power; the energy is that of the bins
    whose frequency lies in [low, high].
    """
    @F.pandas_udf("dominant_bin long, spectral_entropy double, band_energy double")
    def measure(windows: pd.Series) -> pd.DataFrame:
        rows = []
        for v in windows:
            power = np.abs(np.fft.fft(v)[: len(v) // 2]) ** 2
            total = power.sum()
            share = power / total if total > 0 else np.full(len(power), np.nan)
            frequency = np.arange(len(power)) * fs / len(v)
            inside = (frequency >= low) & (frequency <= high)
            rows.append((int(power.argmax()), -(share * np.log2(share + LOG_GUARD)).sum(), power[inside].sum()))
        return pd.DataFrame(rows, columns=["dominant_bin", "spectral_entropy", "band_energy"])

    return measure(values)


_NUMBERS = T.ArrayType(T.DoubleType())


@F.pandas_udf(T.StructType([T.StructField("re", _NUMBERS), T.StructField("im", _NUMBERS)]))
def fft_line(at: pd.Series, re: pd.Series, im: pd.Series, size: pd.Series, line: pd.Series, turns: pd.Series) -> pd.DataFrame:
    """FFT of ``size`` values that are given sparsely by place; bin k is then turned by −2π·line·k / turns."""
    real, imaginary = [], []
    for places, x, y, n, row, whole in zip(at, re, im, size, line, turns):
        values = np.zeros(n, complex)
        values[places] = np.asarray(x) + 1j * np.asarray(y)
        # an exact integer modulo keeps the angle precise in long transforms
        found = np.fft.fft(values) * np.exp(-2j * np.pi * (np.arange(n) * row % whole) / whole)
        real.append(found.real)
        imaginary.append(found.imag)
    return pd.DataFrame({"re": real, "im": imaginary})


def power_spectrum_dft(values: str | Column) -> Column:
    """The same spectrum from sine and cosine sums, without Python."""
    values = F.col(values) if isinstance(values, str) else values
    n = F.size(values)

    def part(k, wave):
        terms = F.transform(values, lambda v, i: v * wave(F.lit(2.0) * F.pi() * k * i / n))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    bins = F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1)
    return F.transform(bins, lambda k: F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def spectral_entropy(power: str | Column) -> Column:
    """−Σ p·log2(p + guard); NULL for a window without power."""
    power = F.col(power) if isinstance(power, str) else power
    # the total is bound once, outside the walk over the bins
    share = F.flatten(F.transform(F.array(_total(power)), lambda t: F.transform(power, lambda v: F.try_divide(v, t))))
    return -_total(F.transform(share, lambda p: p * F.log2(p + F.lit(LOG_GUARD))))
