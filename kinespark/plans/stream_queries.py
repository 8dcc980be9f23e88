"""Queries over streamed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinespark.operators import models, timedomain, windows
from kinespark.plans import sql_parts as S
from kinespark.plans.dataset_queries import DETECTION_SQL, _label_columns, detection_windows_by_supplier
from kinespark.plans.registry import query, r, rounded, with_
from kinespark.plans.views import SERIES, SUBJECT, samples, table
from kinespark.session import stage, stage_path
from kinespark.streaming import live


def event_stream(spark, sf_dir):
    """The events file as a stream, with the same columns as the stored samples."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    subject = F.col("user_id") % 10
    return events.select(
        subject.alias("subject_id"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"),
        "event_id", "ts", (F.col("value") - 34.5).alias("z"),
    )


_LIVE = """live AS (
  SELECT subject_id, side, start_time, start_time + INTERVAL 2 DAY AS end_time, max(z) AS z_max, min(z) AS z_min, count(*) AS samples
  FROM (SELECT subject_id, side, z, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start_time FROM signal)
  GROUP BY subject_id, side, start_time)"""
_CLOSED = " FROM live WHERE end_time <= (SELECT max(ts) - INTERVAL 1 HOUR FROM signal)"


def _extremes(spark, sf_dir):
    return live.sliding_extremes(event_stream(spark, sf_dir), SERIES, width="2 days", slide="1 day", lateness="1 hour")


@query("streamed_window_extremes", with_(S.SIGNAL, _LIVE) + "SELECT *" + _CLOSED)
def streamed_window_extremes(spark, sf_dir):
    """Two-day windows every day, from a stream; windows the watermark has not passed stay open."""
    return live.run_to_table(_extremes(spark, sf_dir), "extremes")


@query("streamed_scores")
def streamed_scores(spark, sf_dir):
    """Each streamed window classified by a model fitted on the stored recordings."""
    train = timedomain.extremes(samples(spark, sf_dir), SERIES).select(
        *SERIES, F.coalesce("left_z_max", "right_z_max").alias("z_max"), F.coalesce("left_z_min", "right_z_min").alias("z_min"),
        F.when(F.col("subject_id") < 5, 0).otherwise(1).alias("label"),
    )
    model = models.fit(stage(train, "train"), ["z_max", "z_min"], "label", models.logistic_regression(100))
    return live.run_to_table(live.score_stream(_extremes(spark, sf_dir), model), "scores")


_COLUMNS_SQL = """user_rows AS (
  SELECT user_id % 10 AS subject_id, ts, event_id, value - 34.5 AS gyro_left_z, CAST(user_id % 97 - 48 AS DOUBLE) AS gyro_right_z,
         value / 100 AS accel_left_z, value / 200 AS accel_right_z FROM events),
both_sensors AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) - 1 AS n FROM user_rows)"""


def _row_windows(spark, sf_dir, **emitted):
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    feed = events.select(
        (F.col("user_id") % 10).alias("subject_id"), "ts", "event_id", (F.col("value") - 34.5).alias("gyro_left_z"),
        (F.col("user_id") % 97 - 48).cast("double").alias("gyro_right_z"), (F.col("value") / 100).alias("accel_left_z"),
        (F.col("value") / 200).alias("accel_right_z"),
    )
    sink = live.RowWindows(spark, feed.schema, SUBJECT, stage_path(spark, "row-windows"), tiebreak=["event_id"], lateness_s=3600, **emitted)
    run = feed.writeStream.foreachBatch(sink).option("checkpointLocation", stage_path(spark, "row-windows-checkpoint"))
    started = run.trigger(availableNow=True).start()
    started.awaitTermination()
    sink.finish(started.lastProgress["batchId"])
    return sink


_ROW_SQL = with_(_COLUMNS_SQL, *DETECTION_SQL[-5:], recursive=True)


@query(
    "streamed_row_windows",
    _ROW_SQL + "SELECT subject_id, CAST(window_id AS BIGINT) AS window_id, start_time, end_time, "
    + ", ".join(r(c, c) for c in windows.TIME_FEATURES) + ", "
    + r("a", "gyro_asymmetry_stride_times") + ", " + r("s", "gyro_symmetry_ratio_stride_times") + f", {_label_columns()}"
    + " FROM windows LEFT JOIN window_labels USING (subject_id, window_id)",
)
def streamed_row_windows(spark, sf_dir):
    """Windows of 200 rows every 100 rows, with features and labels, from a stream."""
    return rounded(_row_windows(spark, sf_dir).windows())


@query(
    "streamed_alerts",
    _ROW_SQL + "SELECT subject_id, CAST(window_id AS BIGINT) AS window_id, " + r("(1 - s) * 100", "stride_diff_pct")
    + " FROM windows JOIN window_labels USING (subject_id, window_id) WHERE (1 - s) * 100 > 10",
)
def streamed_alerts(spark, sf_dir):
    """Streamed windows whose stride times differ by more than 10 percent between the sides, written batch by batch."""
    found = _row_windows(spark, sf_dir, alert_above=10.0).alerts()
    return rounded(found.select("subject_id", "window_id", "stride_diff_pct"))


@query("streamed_window_scores")
def streamed_window_scores(spark, sf_dir):
    """Streamed windows classified batch by batch, with a model fitted on the stored windows of all suppliers."""
    train = stage(detection_windows_by_supplier(spark, sf_dir).filter("label_moderate IN (0, 1)"), "train")
    features = windows.ASYMMETRY_FEATURES
    model = models.fit(train, features, "label_moderate", models.logistic_regression(100))
    found = _row_windows(spark, sf_dir, model=model, features=features).scores()
    return rounded(found.select("subject_id", "window_id", "label_moderate", "probability", "prediction"))
