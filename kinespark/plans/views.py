"""The given tables seen as motion recordings.

``events`` carries ten subjects with a left and a right series each; users 0–4 (mod 10) form the
healthy cohort, the others the stroke cohort. ``lineitem`` gives one series per supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.operators.align import complete_rows, merge_asof, merge_sides, zip_rows
from kinespark.operators.layout import enumerate_rows
from kinespark.session import stage

SUBJECT = ["subject_id"]
SERIES = ["subject_id", "side"]
CENTRE = 34.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sensor samples, not yet numbered."""
    subject = F.col("user_id") % 10
    return table(spark, sf_dir, "events").select(
        subject.alias("subject_id"),
        F.when(subject < 5, 0).otherwise(1).alias("class_label"),
        F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"),
        "event_id",
        "ts",
        (F.col("value") - CENTRE).alias("z"),
    )


def signal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples numbered per subject and side; ``elapsed`` is 1/100 s per row."""
    return enumerate_rows(samples(spark, sf_dir), SERIES, ["ts", "event_id"])


def staged_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signal_long`` written once, for plans that read it several times."""
    return stage(signal_long(spark, sf_dir), "signal")


def signal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly maxima, so that left and right time keys meet."""
    hour = F.dayofyear("ts").cast("bigint") * 24 + F.hour("ts")
    return samples(spark, sf_dir).groupBy(*SERIES, hour.alias("hour_no")).agg(F.max("z").alias("z"))


def bilateral_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged left/right hourly series: subject_id, hour_no, left_z, right_z, n."""
    grid = signal_grid(spark, sf_dir)
    left, right = (grid.filter(F.col("side") == s).drop("side") for s in ("left", "right"))
    return merge_sides(left, right, SUBJECT, "hour_no", ["z"])


def _number() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("double")


def sensor_axes(spark: SparkSession, sf_dir: str, sensor: str) -> DataFrame:
    """Three axes of the gyroscope, or of an accelerometer that misses the samples of one kind of event."""
    events = table(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    if sensor == "gyro":
        axes = {"x": (user % 97 - 48).cast("double"), "y": (event % 101 - 50).cast("double"), "z": F.col("value") - CENTRE}
    else:
        events = events.filter("event_type <> 'error'")
        axes = {"x": (user % 89 - 44) * F.lit(0.01), "y": (event % 103 - 51) * F.lit(0.01), "z": (_number() - 50) * 0.01}
    return events.select(
        (user % 10).alias("subject_id"), F.when(event % 2 == 0, "left").otherwise("right").alias("side"), "ts",
        *[c.alias(name) for name, c in axes.items()],
    )


def bilateral_full(rows: DataFrame, tolerance: Column | None = None, columns: str = "z") -> DataFrame:
    """Both sides of one sensor at full rate: subject_id, ts, left_z, right_z (and other columns), n."""
    left, right = (rows.filter(F.col("side") == s).select(*SUBJECT, "ts", *columns) for s in ("left", "right"))
    return merge_asof(left, right, SUBJECT, "ts", list(columns), tolerance)


def two_sensors(spark: SparkSession, sf_dir: str, columns: str = "z") -> DataFrame:
    """Gyroscope and accelerometer rows at full rate, paired by position; time stamps are the gyroscope's."""
    def rows(sensor):
        merged = bilateral_full(sensor_axes(spark, sf_dir, sensor), columns=columns)
        names = {f"{s}_{c}": f"{sensor}_{s}_{c}" for s in ("left", "right") for c in columns}
        return stage(complete_rows(merged, SUBJECT).withColumnsRenamed(names), sensor)

    return zip_rows(rows("gyro"), rows("accel").drop("ts"), SUBJECT)


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier, ordered by ship date."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_quantity") - 25.5).cast("double").alias("z")
    )
    return enumerate_rows(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
