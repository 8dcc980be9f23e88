"""Bringing left and right (and gyroscope and accelerometer) rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.operators.layout import BLOCK, SERIES_LIMIT, attach, enumerate_rows, running
from kinespark.session import stage

AXES = ("elapsed", "x", "y", "z")


def forward_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pos: str = "n",
                 size: int = BLOCK) -> DataFrame:
    """Replace NULL by the last earlier value of the same series."""
    rows = running(df, keys, pos, lasts={f"_f_{c}": F.col(c) for c in columns}, size=size)
    filled = {c: F.coalesce(c, f"_f_{c}").alias(c) for c in columns}
    return rows.select(*[filled.get(c, F.col(c)) for c in df.columns])


def merge_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str = "ts",
                columns: Sequence[str] = AXES, size: int = BLOCK, limit: int = SERIES_LIMIT) -> DataFrame:
    """Full outer join of both sides on the time stamp, forward-filled in time order.

    Equal time stamps multiply. Rows before the later side starts keep NULLs. The merged series is
    written once; ``n`` numbers its rows.
    """
    keys = list(keys)

    def side(df, name):
        return df.select(*keys, time, *[F.col(c).alias(f"{name}_{c}") for c in columns])

    both = stage(side(left, "left").join(side(right, "right"), [*keys, time], "full"), "merged")
    values = [f"{s}_{c}" for s in ("left", "right") for c in columns]
    # equal time stamps need a fixed order; rows alike in every column are interchangeable
    rows = enumerate_rows(both, keys, [time, *values], limit=limit)
    return forward_fill(rows, keys, values, size=size)


def merge_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str = "ts", columns: Sequence[str] = AXES,
               tolerance: Column | None = None, ranges: int | None = None) -> DataFrame:
    """One row per time stamp of either side, with each side's last row at or before it; ``n`` numbers the rows.

    Both sides are interleaved by one range partitioning of (keys, time), which cuts a hot recording into as many
    ranges as it needs and serves the grouping of equal stamps too. The last values and the number of rows of
    each range (one small row per recording and range) are carried into the ranges after it. Where no side
    repeats a stamp the rows are those of :func:`merge_sides`; of rows with one stamp the greatest counts, compared column by
    column. A value older than ``tolerance`` (an interval, or a number for numeric time) is NULL. Rows without
    time are left out.
    """
    keys, sides = list(keys), ("left", "right")

    def side(df, name):
        row = F.struct(F.col(time).alias("_at"), *[F.col(c).alias(c) for c in columns])
        return df.filter(F.col(time).isNotNull()).select(*keys, time, row.alias(name))

    both = side(left, "left").unionByName(side(right, "right"), allowMissingColumns=True)
    ranged = both.repartitionByRange(*([ranges] if ranges else []), *keys, time)
    stamps = ranged.groupBy(*keys, time).agg(*[F.max(s).alias(s) for s in sides])
    stored = stage(stamps.withColumn("_range", F.spark_partition_id()), "stamps")

    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = stored.groupBy("_range", *keys).agg(F.count("*").alias("_rows"), *[F.max(s).alias(s) for s in sides])
    carried = stage(ends.select(
        "_range", *keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.last(s, ignorenulls=True).over(earlier).alias(f"_{s}") for s in sides],
    ), "carried")

    w = Window.partitionBy("_range", *keys).orderBy(time)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = stored.select(
        "_range", *keys, time, (F.row_number().over(w).cast("long") - 1).alias("_row"),
        *[F.last(s, ignorenulls=True).over(upto).alias(s) for s in sides],
    ).join(carried, ["_range", *keys])
    found = filled.select(
        *keys, time, (F.col("_row") + F.col("_before")).alias("n"), *[F.coalesce(s, f"_{s}").alias(s) for s in sides]
    )
    if tolerance is not None:
        fresh = {s: F.when(F.col(time) - F.col(f"{s}._at") <= tolerance, F.col(s)) for s in sides}
        found = found.withColumns(fresh)
    return found.select(*keys, time, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sides for c in columns], "n")


def complete_rows(df: DataFrame, keys: Sequence[str], pos: str = "n") -> DataFrame:
    """Drop rows with a NULL and number the rest again.

    After :func:`forward_fill` only the head of a series can have NULLs, so the new position is the
    old one minus the length of that head: one small aggregation instead of a sort.
    """
    whole = df.na.drop("any")
    heads = whole.groupBy(*keys).agg(F.min(pos).alias("_head"))
    return attach(whole, heads, keys, pos).withColumn(pos, F.col(pos) - F.col("_head")).drop("_head")


def zip_rows(first: DataFrame, second: DataFrame, keys: Sequence[str], pos: str = "n") -> DataFrame:
    """Pair the i-th rows of two numbered series; the longer one's surplus drops out."""
    return first.join(second, [*keys, pos])


def common_interval(df: DataFrame, keys: Sequence[str], pos: str = "n", elapsed: str = "elapsed",
                    keep_early: bool = False) -> DataFrame:
    """Clip both sides to the time they share and shift it to start at 0 (``synced``).

    The shared start is the later of both first times, the shared end the earlier of both last
    ones. ``keep_early`` leaves the rows before the shared start in, with negative times.
    """
    keys = list(keys)
    ends = df.groupBy(*keys, "side").agg(
        F.min_by(elapsed, pos).alias("_first"), F.max_by(elapsed, pos).alias("_last")
    )
    shared = ends.groupBy(*keys).agg(F.max("_first").alias("_start"), F.min("_last").alias("_end"))
    synced = attach(df, shared, keys, pos).withColumn("synced", F.col(elapsed) - F.col("_start"))
    clipped = synced.filter(F.col("synced") <= F.col("_end") - F.col("_start"))
    if not keep_early:
        clipped = clipped.filter(F.col("synced") >= 0)
    return clipped.drop("_start", "_end")


def sides_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shared: Sequence[str] = ("n", "ts")) -> DataFrame:
    """Wide left/right columns as one row per side."""
    sides = [
        F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in columns]) for s in ("left", "right")
    ]
    return df.select(*keys, *shared, F.inline(F.array(*sides)))
