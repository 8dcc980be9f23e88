"""Stride, stance/swing and cross-limb metrics of whole recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.scalar import asymmetry_index, correlation, seconds_between, symmetry_ratio
from kinespark.operators.layout import running
from kinespark.operators.peaks import find_peaks, strides
from kinespark.operators.phases import durations, paired, phases
from kinespark.operators.smoothing import low_pass
from kinespark.session import stage

STRIDE_HEIGHT, STRIDE_DISTANCE = 0.5, 100
CYCLE_SECONDS, CYCLE_MIN_ROWS = 0.5, 5
CROSS_LIMB = (
    "left_stride_duration", "right_stride_duration", "stride_duration_diff", "stride_duration_symmetry_ratio",
    "left_peak", "right_peak", "peak_diff", "z_corr",
)


def stride_times(df: DataFrame, keys: Sequence[str], height: float = STRIDE_HEIGHT,
                 distance: float = STRIDE_DISTANCE, keep: Sequence[str] = ()) -> DataFrame:
    """Samples between consecutive peaks of each side; ``keys`` exclude ``side``."""
    by = [*keys, "side"]
    return strides(find_peaks(df, by, height=height, distance=distance, keep=keep), by, start=keep)


def stride_symmetry(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Asymmetry index and symmetry ratio of the k-th left and right stride."""
    left, right = (found.filter(F.col("side") == s) for s in ("left", "right"))
    return paired(left, right, keys, "stride_no", ["stride_samples"]).select(
        "*",
        asymmetry_index("left_stride_samples", "right_stride_samples").alias("asymmetry_index"),
        symmetry_ratio("left_stride_samples", "right_stride_samples").alias("symmetry_ratio"),
    )


def stance_swing(df: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Stance and swing seconds per phase of at least two rows, on the unfiltered signal."""
    by = [*keys, "side"]
    return durations(phases(df, by, time=time, min_len=2), by)


def summarize_symmetry(symmetry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return symmetry.groupBy(*keys).agg(
        F.avg("asymmetry_index").alias("asymmetry_index"), F.avg("symmetry_ratio").alias("symmetry_ratio")
    )


def cycles(df: DataFrame, keys: Sequence[str], fs: float = 100.0, elapsed: str = "elapsed",
           distance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Cut the filtered signal of each side into cycles from peak to peak.

    Returns the cycles (``cycle_no``, start and end position and elapsed time) and the rows with
    their ``cycle_no`` and index ``k`` in the cycle. Rows before the first and after the last peak
    belong to no cycle.
    """
    by = [*keys, "side"]
    smooth = stage(low_pass(df, by, fs=fs, keep=[elapsed]), "smooth")
    peaks = stage(
        find_peaks(smooth, by, value="z_filtered", distance=distance or fs * CYCLE_SECONDS, keep=[elapsed]), "cycle-peaks"
    )
    found = strides(peaks, by, start=[elapsed]).select(
        *by, F.col("stride_no").alias("cycle_no"), "start_n", "end_n",
        F.col(f"start_{elapsed}").alias("start_s"), F.col(f"end_{elapsed}").alias("end_s"),
    )
    # each peak goes in front of the row at its position, so one ordered pass numbers the cycles
    marks = peaks.select(*by, "n", F.lit(None).cast("double").alias("z_filtered"), F.lit(0).alias("_kind"))
    rows = smooth.select(*by, "n", "z_filtered", F.lit(1).alias("_kind")).unionByName(marks)
    mark = F.col("_kind") == 0
    rows = running(
        rows, by, totals={"_seen": mark.cast("long")}, lasts={"_from": F.when(mark, F.col("n"))}, order=["_kind"]
    )
    rows = rows.filter((F.col("_kind") == 1) & (F.col("_seen") > 0)).select(
        *by, (F.col("_seen") - 1).alias("cycle_no"), (F.col("n") - F.col("_from")).alias("k"), "z_filtered"
    )
    return found, rows


def cross_limb(df: DataFrame, keys: Sequence[str], fs: float = 100.0, elapsed: str = "elapsed",
               distance: float | None = None) -> DataFrame:
    """Durations, peaks and correlation of the i-th left and the i-th right cycle.

    The correlation pairs the k-th samples of both cycles up to the shorter one's length. Cycles in
    which that is below five samples are left out.
    """
    keys = list(keys)
    found, rows = cycles(df, keys, fs, elapsed, distance)
    left, right = (found.filter(F.col("side") == s) for s in ("left", "right"))
    spans = paired(left, right, keys, "cycle_no", ["start_n", "end_n", "start_s", "end_s"]).select(
        *keys, "cycle_no",
        (F.col("left_end_n") - F.col("left_start_n")).alias("_left_rows"),
        (F.col("right_end_n") - F.col("right_start_n")).alias("_right_rows"),
        (F.col("left_end_s") - F.col("left_start_s")).alias("left_stride_duration"),
        (F.col("right_end_s") - F.col("right_start_s")).alias("right_stride_duration"),
    ).filter(F.least("_left_rows", "_right_rows") >= CYCLE_MIN_ROWS)

    def of(side):
        return F.max(F.when(F.col("side") == side, F.col("z_filtered"))).alias(side)

    # k-th samples side by side, then one row per cycle; both aggregations combine before shuffling
    samples = rows.groupBy(*keys, "cycle_no", "k").agg(of("left"), of("right"))
    shapes = samples.groupBy(*keys, "cycle_no").agg(
        F.max("left").alias("left_peak"), F.max("right").alias("right_peak"), correlation("left", "right").alias("z_corr")
    )
    a, b = F.col("left_stride_duration"), F.col("right_stride_duration")
    return spans.join(shapes, [*keys, "cycle_no"]).select(
        *keys, "cycle_no", "left_stride_duration", "right_stride_duration",
        F.abs(a - b).alias("stride_duration_diff"),
        F.try_divide(F.least(a, b), F.greatest(a, b)).alias("stride_duration_symmetry_ratio"),
        "left_peak", "right_peak",
        F.abs(F.col("left_peak") - F.col("right_peak")).alias("peak_diff"),
        "z_corr",
    )


def mean_and_std(df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``{column}_mean`` and ``{column}_std`` of every column that is neither a key nor excluded."""
    out = []
    for c in df.columns:
        if c not in {*keys, *exclude}:
            out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out)


def cadence(df: DataFrame, keys: Sequence[str], height: float = STRIDE_HEIGHT,
            distance: float = STRIDE_DISTANCE) -> DataFrame:
    """Stride time in seconds per side, step time between alternating sides, steps per minute."""
    keys = list(keys)
    by = [*keys, "side"]
    peaks = stage(find_peaks(df, by, height=height, distance=distance, keep=["ts"]), "step-peaks")
    stride_s = strides(peaks, by, start=["ts"]).select(
        *by, seconds_between("start_ts", "end_ts").alias("stride_s")
    )
    per_side = stride_s.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "left", F.col("stride_s"))).alias("left_stride_s"),
        F.avg(F.when(F.col("side") == "right", F.col("stride_s"))).alias("right_stride_s"),
    )
    # a step is a peak whose previous peak, of either side, was on the other side; the hour in the
    # partition key bounds the group, and the last peak of earlier hours is carried in
    return per_side.join(_steps(peaks, keys), keys)


def _steps(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    timed = peaks.withColumn("_us", F.timestamp_diff("MICROSECOND", zero, F.col("ts")))
    hour = 3_600_000_000
    timed = timed.withColumn("_hour", F.floor(F.col("_us") / hour))
    w = Window.partitionBy(*keys, "_hour").orderBy("_us", "side")
    this = F.struct("_us", "side")
    inside = timed.select(*keys, "_hour", "_us", "side", F.lag(this).over(w).alias("_before"))
    tails = timed.groupBy(*keys, "_hour").agg(F.max(this).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_hour")
    tails = tails.select(*keys, "_hour", F.lag("_tail").over(earlier).alias("_carried"))
    rows = inside.join(tails, [*keys, "_hour"]).withColumn("_before", F.coalesce("_before", "_carried"))
    step = F.when(F.col("_before.side") != F.col("side"), (F.col("_us") - F.col("_before._us")) / 1_000_000)
    minutes = (F.max("_us") - F.min("_us")) / 60_000_000
    return rows.groupBy(*keys).agg(
        F.avg(step).alias("step_s"), F.try_divide(F.count("*"), minutes).alias("steps_per_minute")
    )
