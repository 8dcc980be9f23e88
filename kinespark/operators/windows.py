"""Sliding row windows: detection features, labels and raw tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.scalar import asymmetry_index, symmetry_ratio

WINDOW_SECONDS, STRIDE_SECONDS = 2, 1
PEAK_HEIGHT, PEAK_DISTANCE = 0.3, 80

# Asymmetry above the first or symmetry below the second makes a window asymmetric.
LABEL_LIMITS = {"strict": (0.2, 0.8), "moderate": (0.15, 0.85), "lenient": (0.1, 0.9)}
UNDEFINED = 2

CHANNELS = [f"{sensor}_{side}_{axis}" for sensor in ("gyro", "accel") for side in ("left", "right") for axis in "xyz"]
TIME_FEATURES = [
    f"{sensor}_{s}_z_{f}" for sensor in ("gyro", "accel") for s in ("right", "left") for f in ("max", "min")
]
ASYMMETRY_FEATURES = ["gyro_asymmetry_stride_times", "gyro_symmetry_ratio_stride_times"]
LABELS = [f"label_{name}" for name in LABEL_LIMITS]


def sliding_windows(df: DataFrame, pos: str = "n", rows: int = 200, step: int = 100) -> DataFrame:
    """Copy each row into every window of ``rows`` rows that covers it; windows start every ``step`` rows."""
    n = F.col(pos)
    first = F.greatest(F.lit(0), F.ceil((n - (rows - 1)) / F.lit(step)))
    return df.filter(first <= F.floor(n / step)).withColumn(
        "window_id", F.explode(F.sequence(first, F.floor(n / step)))
    )


def thin_peaks(peaks: Column, distance: int) -> Column:
    """Positions that survive minimum-distance thinning; ``peaks`` holds structs (height, position).

    For the few candidates of one window; :func:`kinespark.operators.peaks.thin_out` does whole series.
    """
    kept = F.aggregate(
        F.reverse(F.array_sort(peaks)),
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y - x["p"]) < distance), acc).otherwise(
            F.concat(acc, F.array(x["p"]))
        ),
    )
    return F.array_sort(kept)


def differences(positions: Column) -> Column:
    """Steps between consecutive array elements."""
    steps = F.transform(positions, lambda p, i: p - F.get(positions, i - 1))
    return F.filter(steps, lambda s: s.isNotNull())


def mean_of(values: Column) -> Column:
    """Mean of an array, NULL when empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values))


def labels(left_peaks: Column, right_peaks: Column, asymmetry: Column, symmetry: Column) -> dict[str, Column]:
    """Three labels from the first stride pair: 1 asymmetric, 0 symmetric, 2 when a side has no stride."""
    defined = (F.size(left_peaks) > 1) & (F.size(right_peaks) > 1)
    a, s = F.abs(F.get(asymmetry, F.lit(0))), F.get(symmetry, F.lit(0))
    return {
        f"label_{name}": F.when(~defined, UNDEFINED).when((a > high) | (s < low), 1).otherwise(0)
        for name, (high, low) in LABEL_LIMITS.items()
    }


def detection_windows(df: DataFrame, keys: Sequence[str], rows: int = 200, step: int = 100,
                      height: float = PEAK_HEIGHT, distance: int = PEAK_DISTANCE, time: str = "ts",
                      tensor: Sequence[str] = ()) -> DataFrame:
    """Features, labels and (for the columns in ``tensor``) the raw matrix of every full window.

    ``df`` has ``n``, the time and the z columns of both sensors and sides. Rows are shuffled once
    by (keys, window); the peak search and the aggregation reuse that layout. Everything collected
    is bounded by the window length.
    """
    keys = [*keys, "window_id"]
    z = {s: f"gyro_{s}_z" for s in ("left", "right")}
    accel = {s: f"accel_{s}_z" for s in ("left", "right")}
    wide = sliding_windows(
        df.select(*dict.fromkeys([*keys[:-1], "n", time, *z.values(), *accel.values(), *tensor])), "n", rows, step
    ).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy("n")
    wide = wide.select("*", *[F.lag(c).over(w).alias(f"_prev_{s}") for s, c in z.items()])

    def change(s):
        c, prev = F.col(z[s]), F.col(f"_prev_{s}")
        return F.when(c != prev, F.struct(F.col("n").alias("at"), (c > prev).alias("rise")))

    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select("*", *[F.last(change(s), ignorenulls=True).over(before).alias(f"_last_{s}") for s in z])

    def candidates(s):
        falls = (F.col(z[s]) < F.col(f"_prev_{s}")) & F.col(f"_last_{s}.rise") & (F.col(f"_prev_{s}") >= height)
        at = F.floor((F.col(f"_last_{s}.at") + F.col("n") - 1) / 2)
        return F.collect_list(F.when(falls, F.struct(F.col(f"_prev_{s}").alias("h"), at.alias("p"))))

    raw = [F.collect_list(F.struct("n", F.array(*tensor).alias("v"))).alias("_raw")] if tensor else []
    grouped = wide.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.min_by(time, "n").alias("start_time"),
        F.max_by(time, "n").alias("end_time"),
        *[F.max(c).alias(f"{c}_max") for c in (*z.values(), *accel.values())],
        *[F.min(c).alias(f"{c}_min") for c in (*z.values(), *accel.values())],
        *[candidates(s).alias(f"_peaks_{s}") for s in z],
        *raw,
    ).filter(F.col("_rows") == rows)
    kept = grouped.select("*", *[thin_peaks(F.col(f"_peaks_{s}"), distance).alias(f"_kept_{s}") for s in z])
    pairs = kept.withColumn(
        "_pairs",
        F.filter(
            F.arrays_zip(differences(F.col("_kept_left")).alias("l"), differences(F.col("_kept_right")).alias("r")),
            lambda p: p["l"].isNotNull() & p["r"].isNotNull(),
        ),
    )
    pairs = pairs.select(
        "*",
        F.transform("_pairs", lambda p: asymmetry_index(p["l"], p["r"])).alias("_asymmetry"),
        F.transform("_pairs", lambda p: symmetry_ratio(p["l"], p["r"])).alias("_symmetry"),
    )
    found = labels(F.col("_kept_left"), F.col("_kept_right"), F.col("_asymmetry"), F.col("_symmetry"))
    return pairs.select(
        *keys, "start_time", "end_time", *TIME_FEATURES,
        mean_of(F.col("_asymmetry")).alias("gyro_asymmetry_stride_times"),
        mean_of(F.col("_symmetry")).alias("gyro_symmetry_ratio_stride_times"),
        *[c.alias(name) for name, c in found.items()],
        *([F.array_sort("_raw")["v"].alias("x")] if tensor else []),
    )


def channel_statistics(tensors: DataFrame, column: str = "x") -> DataFrame:
    """Mean and population standard deviation of each channel over all windows and samples."""
    samples = tensors.select(F.explode(column).alias("_row")).select(F.posexplode("_row").alias("channel", "v"))
    return samples.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def normalise_channels(tensors: DataFrame, statistics: DataFrame, column: str = "x") -> DataFrame:
    """(x − mean) / (std + 1e-7) per channel.

    The statistics are read back as literals, as any fitted scaler's are: one entry per channel.
    """
    fitted = sorted(statistics.select("channel", "mean", "std").collect())
    mean = F.array(*[F.lit(r["mean"]) for r in fitted])
    width = F.array(*[F.lit(r["std"] + 1e-7) for r in fitted])
    scaled = F.transform(
        column, lambda sample: F.transform(sample, lambda v, i: (v - F.get(mean, i)) / F.get(width, i))
    )
    return tensors.withColumn(column, scaled)
