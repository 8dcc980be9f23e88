"""Spectral features in tumbling time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.spectral import LOG_GUARD, fft_line, window_measures
from kinespark.operators.layout import attach, longest_series
from kinespark.session import stage

BAND = (0.5, 3.0)  # Hz
FFT_LIMIT = 1_000_000  # samples of one window that are transformed as one array
WINDOW = ("window_id", "start_time", "end_time")
FEATURES = ("dominant_freq", "spectral_entropy", "gait_band_energy")


def tumbling_windows(df: DataFrame, keys: Sequence[str], width_s: float, time: str = "ts",
                     spread: str = "n") -> DataFrame:
    """Add ``window_id``, ``start_time`` and ``end_time`` of the window a row falls into.

    Windows are anchored at the series' first time stamp; a window counts only if it ends no later
    than the last one. Empty windows use up their id.
    """
    keys = list(keys)
    width = round(width_s * 1_000_000)
    ends = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))

    def micros(start, end):
        return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))

    def at(number):
        return F.timestamp_add("MICROSECOND", number * width, F.col("_t0"))

    rows = attach(df, ends, keys, spread).withColumn("window_id", F.floor(micros("_t0", time) / width))
    whole = (F.col("window_id") + 1) * width <= micros("_t0", "_t1")
    return (
        rows.filter(whole)
        .withColumn("start_time", at(F.col("window_id")))
        .withColumn("end_time", at(F.col("window_id") + 1))
        .drop("_t0", "_t1")
    )


def spectral_windows(df: DataFrame, keys: Sequence[str], window_keys: Sequence[str] | None = None, value: str = "z",
                     time: str = "ts", pos: str = "n", fs: float = 100.0, width_s: float = 2.0,
                     fft_limit: int = FFT_LIMIT) -> DataFrame:
    """Dominant frequency, spectral entropy and band energy per window and series.

    ``window_keys`` names the keys that share a window grid (default: all of ``keys``). A window of
    up to ``fft_limit`` samples is one array and one FFT; a larger one is an FFT whose columns and rows
    are spread over many tasks.
    """
    keys = list(keys)
    df = df.select(*keys, pos, time, value)
    rows = tumbling_windows(df, window_keys or keys, width_s, time, pos)
    by = [*keys, *WINDOW]
    # no window is longer than its series
    if longest_series(df, keys) <= fft_limit:
        return _in_one_piece(rows, by, value, pos, fs)
    large = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.min(pos).alias("_first"))
    large = stage(large.filter(F.col("samples") > fft_limit), "large-windows")
    if large.isEmpty():
        return _in_one_piece(rows, by, value, pos, fs)
    return _in_one_piece(rows.join(large.select(*by), by, "left_anti"), by, value, pos, fs).unionByName(
        _in_lines(attach(rows, large, by, pos, stored=True), by, value, pos, fs)
    )


def _in_one_piece(rows: DataFrame, by: Sequence[str], value: str, pos: str, fs: float) -> DataFrame:
    samples = (
        rows.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(pos, value)))[value].alias("_values"))
        .withColumn("samples", F.size("_values").cast("long"))
        .filter(F.col("samples") >= 2)
    )
    measured = samples.select(*by, "samples", window_measures("_values", fs, *BAND).alias("_m"))
    return measured.select(
        *by,
        (F.col("_m.dominant_bin") * fs / F.col("samples")).alias("dominant_freq"),
        F.col("_m.spectral_entropy").alias("spectral_entropy"),
        F.col("_m.band_energy").alias("gait_band_energy"),
        "samples",
    )


def spread_fft(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fourier transform of series of 2^``e`` complex values (by, e, i, re, im); absent places are 0.

    The places form a matrix of 2^(e//2) rows. Its columns are transformed and turned, then its
    rows: no task holds more than lines of about √(2^e) values.
    """
    def power_of_two(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), exponent).cast("long")

    def lines(df: DataFrame, line: str, place: str, size: Column, turns: Column, bin_name: str) -> DataFrame:
        values = F.array_sort(F.collect_list(F.struct(place, "re", "im")))
        held = df.groupBy(*by, "e", line).agg(values.alias("_v"))
        moved = fft_line(F.col(f"_v.{place}"), F.col("_v.re"), F.col("_v.im"), size, line, turns)
        return held.select(*by, "e", line, moved.alias("_f")).select(
            *by, "e", line, F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias(bin_name, "_c")
        ).select(*by, "e", line, F.col(bin_name).cast("long").alias(bin_name), "_c.re", "_c.im")

    upper, lower = power_of_two(F.floor(F.col("e") / 2)), power_of_two(F.ceil(F.col("e") / 2))
    cells = rows.select(*by, "e", "re", "im", F.floor(F.col("i") / lower).alias("_j1"), F.pmod("i", lower).alias("_j2"))
    columns = lines(cells, "_j2", "_j1", upper, upper * lower, "_k1")
    bins = lines(columns, "_k1", "_j2", lower, F.lit(1).cast("long"), "_k2")
    return bins.select(*by, "e", (F.col("_k1") + upper * F.col("_k2")).alias("i"), "re", "im")


def _in_lines(rows: DataFrame, by: Sequence[str], value: str, pos: str, fs: float) -> DataFrame:
    """The same measures of windows of any length; ``rows`` carry ``samples`` and the window's ``_first`` position.

    A length that is no power of two is brought to one: the spectrum's absolute values are those of
    the convolution of the samples, turned by −πj²/n, with the opposite turns.
    """
    by, n = [*by, "samples"], F.col("samples")
    j = F.col(pos) - F.col("_first")
    angle = F.pmod(j * j, 2 * n) * F.pi() / n
    turned = stage(rows.select(
        *by, F.ceil(F.log2((2 * n - 1).cast("double"))).cast("int").alias("e"), j.alias("j"),
        F.col(value).alias("v"), F.cos(angle).alias("c"), F.sin(angle).alias("s"),
    ), "turned")
    signal = turned.select(*by, "e", F.lit(0).alias("_part"), F.col("j").alias("i"),
                           (F.col("v") * F.col("c")).alias("re"), (-F.col("v") * F.col("s")).alias("im"))
    mirrored = F.pow(F.lit(2.0), F.col("e")).cast("long") - F.col("j")
    places = F.when(F.col("j") == 0, F.array("j")).otherwise(F.array(F.col("j"), mirrored))
    turns = turned.select(*by, "e", F.lit(1).alias("_part"), F.explode(places).alias("i"), F.col("c").alias("re"), F.col("s").alias("im"))
    both = spread_fft(signal.unionByName(turns), [*by, "_part"])

    def part(number: int, name: str) -> Column:
        return F.max(F.when(F.col("_part") == number, F.col(name)))

    product = both.groupBy(*by, "e", "i").agg(*[part(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("re", "im")])
    # the inverse transform is the transform of the conjugate, up to a sign that the absolute value drops
    product = product.select(
        *by, "e", "i", (F.col("re0") * F.col("re1") - F.col("im0") * F.col("im1")).alias("re"),
        (-F.col("re0") * F.col("im1") - F.col("im0") * F.col("re1")).alias("im"),
    )
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.pow(F.lit(4.0), F.col("e"))
    half = spread_fft(product, by).filter(F.col("i") < F.floor(n / 2))
    spectrum = stage(half.select(*by, F.col("i").alias("bin"), power.alias("power")), "spectrum")
    totals = spectrum.groupBy(*by).agg(F.sum("power").alias("_total"))
    spectrum = attach(spectrum, totals, by, "bin")
    share = F.try_divide("power", "_total")
    inside = (F.col("bin") * fs / F.col("samples")).between(*BAND)
    return spectrum.groupBy(*by).agg(
        F.max_by("bin", F.struct("power", -F.col("bin"))).alias("_top"),
        (-F.sum(share * F.log2(share + F.lit(LOG_GUARD)))).alias("spectral_entropy"),
        F.sum(F.when(inside, F.col("power")).otherwise(0.0)).alias("gait_band_energy"),
    ).select(
        *by[:-1], (F.col("_top") * fs / n).alias("dominant_freq"), "spectral_entropy", "gait_band_energy", "samples"
    )


def summarize_spectra(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and standard deviation per side, as one row per subject (12 columns)."""
    out = []
    for side in ("left", "right"):
        for feature in FEATURES:
            c = F.when(F.col("side") == side, F.col(feature))
            out += [F.avg(c).alias(f"{side}_{feature}_mean"), F.stddev_samp(c).alias(f"{side}_{feature}_std")]
    return windows.groupBy(*keys).agg(*out)
