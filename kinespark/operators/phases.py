"""Zero crossings, stance/swing phases and the alerts that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.scalar import percent_difference, seconds_between
from kinespark.operators.layout import BLOCK, running, with_neighbours


def zero_crossings(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n",
                   size: int = BLOCK) -> DataFrame:
    """Rows after which the sign changes. An exact zero is crossed twice: into it and out of it."""
    rows = with_neighbours(df, keys, {"_next": (value, 1)}, pos, size)
    return rows.filter(F.signum("_next") != F.signum(value)).drop("_next")


def phases(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n", time: str = "ts",
           min_len: int = 2, size: int = BLOCK) -> DataFrame:
    """Segments between consecutive zero crossings, split at their lowest point.

    Returns ``phase_no`` (0-based among the segments of at least ``min_len`` rows), the positions
    and times of start, minimum (the first of equal ones) and end. The stance phase runs from start
    to minimum, the swing phase from minimum to end.
    """
    keys = list(keys)
    rows = df.select(*keys, pos, value, time)
    rows = with_neighbours(
        rows, keys, {"_next": (value, 1), "_next_time": (time, 1)}, pos, size, keep_block=True
    )
    crossing = F.coalesce(F.signum("_next") != F.signum(value), F.lit(False))
    rows = running(rows, keys, pos, totals={"_segment": crossing.cast("long")}, size=size)
    # partial aggregates combine before the shuffle, so a long flat segment is not one task's load
    segments = (
        rows.filter(F.col("_segment") > 0)
        .groupBy(*keys, "_segment")
        .agg(
            F.min(pos).alias("start_n"),
            F.min_by(F.struct(F.col(pos).alias("n"), F.col(time).alias("t")), F.struct(value, pos)).alias("_low"),
            (F.max(pos) + 1).alias("end_n"),
            F.min_by(time, pos).alias("start_t"),
            F.max_by("_next_time", pos).alias("end_t"),
        )
        .filter(F.col("end_t").isNotNull() & (F.col("end_n") - F.col("start_n") >= min_len))
    )
    segments = running(segments, keys, "start_n", totals={"_no": F.lit(1)}, size=size)
    return segments.select(
        *keys,
        (F.col("_no") - 1).alias("phase_no"),
        "start_n",
        F.col("_low.n").alias("min_n"),
        "end_n",
        "start_t",
        F.col("_low.t").alias("min_t"),
        "end_t",
    )


def durations(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stance and swing seconds per phase; times may be timestamps or seconds."""
    elapsed = seconds_between if dict(found.dtypes)["start_t"].startswith("timestamp") else _difference
    return found.select(
        *keys,
        "phase_no",
        elapsed("start_t", "min_t").alias("stance_s"),
        elapsed("min_t", "end_t").alias("swing_s"),
    )


def _difference(start: str, end: str) -> Column:
    return F.col(end) - F.col(start)


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], number: str, columns: Sequence[str]) -> DataFrame:
    """Left and right rows with the same ordinal; the longer side's surplus drops out."""
    def side(df, name):
        return df.select(*keys, number, *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return side(left, "left").join(side(right, "right"), [*keys, number])


def phase_differences(timed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent difference of the k-th left and right stance and swing durations."""
    both = paired(
        timed.filter(F.col("side") == "left"), timed.filter(F.col("side") == "right"),
        keys, "phase_no", ["stance_s", "swing_s"],
    )
    return both.select(
        "*",
        percent_difference("left_stance_s", "right_stance_s").alias("stance_diff_pct"),
        percent_difference("left_swing_s", "right_swing_s").alias("swing_diff_pct"),
    )


def asymmetry_alerts(differences: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Cycles whose stance or swing durations differ by more than ``threshold`` percent."""
    stance = F.coalesce(F.col("stance_diff_pct") > threshold, F.lit(False))
    swing = F.coalesce(F.col("swing_diff_pct") > threshold, F.lit(False))
    return differences.withColumn("stance_alert", stance).withColumn("swing_alert", swing).filter(stance | swing)


def phase_shares(timed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stance and swing as percent of the cycle, per phase."""
    cycle = F.col("stance_s") + F.col("swing_s")
    return timed.select(
        *keys,
        "phase_no",
        F.try_divide(F.col("stance_s"), cycle).alias("stance_share"),
        F.try_divide(F.col("swing_s"), cycle).alias("swing_share"),
    ).select(
        *keys, "phase_no",
        (F.col("stance_share") * 100).alias("stance_pct"), (F.col("swing_share") * 100).alias("swing_pct"),
    )


def temporal_symmetry(timed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(right swing / right stance) / (left swing / left stance) from each side's mean durations."""
    def mean(side, column):
        return F.avg(F.when(F.col("side") == side, F.col(column)))

    return timed.groupBy(*keys).agg(
        F.try_divide(mean("right", "swing_s"), mean("right", "stance_s")).alias("right_ratio"),
        F.try_divide(mean("left", "swing_s"), mean("left", "stance_s")).alias("left_ratio"),
    ).withColumn("temporal_symmetry", F.try_divide("right_ratio", "left_ratio"))
