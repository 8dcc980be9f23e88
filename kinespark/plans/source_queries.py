"""Queries through files: normalising, scanning, rejecting, storing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinespark.functions.scalar import clean_timestamp_text, parse_timestamp, round_half_even, unbracket
from kinespark.plans import sql_parts as S
from kinespark.plans.registry import query, r, rounded, with_
from kinespark.plans.views import samples, table
from kinespark.session import stage_path
from kinespark.sources import sensors, tables

_VENDOR_SQL = """vendor AS (
  SELECT user_id % 10 AS subject_id, event_id AS row_no, value / 7 AS x, value / 11 AS y, value / 13 AS z,
         epoch_us(ts) // 1000 AS ms FROM events),
started AS (SELECT *, CAST(ms - arg_min(ms, row_no) OVER (PARTITION BY subject_id) AS DOUBLE) / 1000 AS elapsed FROM vendor)"""


def _vendor_rows(spark, sf_dir):
    """Events in the vendor's columns, one file per subject; the counter is in milliseconds."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    millis = F.floor(F.timestamp_diff("MICROSECOND", zero, F.col("ts")) / 1000).cast("double")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("subject_id"), F.col("event_id").alias("_c0"),
        (F.col("value") / 7).alias("Gyro1x"), (F.col("value") / 11).alias("Gyro1y"), (F.col("value") / 13).alias("Gyro1z"),
        F.date_format("ts", "HH:mm:ss").alias("Time"), millis.alias("microsecond"), F.lit(None).cast("double").alias("elasped_time"),
    )


@query(
    "vendor_file_normalisation",
    with_(_VENDOR_SQL)
    + "SELECT subject_id, row_no, " + r("elapsed", "elapsed", 3) + ", "
    + r("epoch_us(TIMESTAMP '2024-08-21 09:35:00') / 1000.0 + elapsed * 1000", "epoc_ms", 3)
    + ", TIMESTAMP '2024-08-21 09:35:00' + to_microseconds(CAST(round(elapsed * 1000000) AS BIGINT)) AS ts, "
    + ", ".join(r(f"round_even({a} * 1000, 0) / 1000", a) for a in "xyz") + " FROM started",
)
def vendor_file_normalisation(spark, sf_dir):
    """Vendor CSV files written, scanned again and brought to the canonical columns."""
    base = stage_path(spark, "vendor")
    rows = _vendor_rows(spark, sf_dir)
    rows.repartitionByRange("subject_id", "_c0").sortWithinPartitions("subject_id", "_c0").write.partitionBy("subject_id").csv(base, header=True)
    scanned = sensors.scan_vendor(spark, f"{base}/subject_id=*", "gyroscope")
    scanned = scanned.withColumn("subject_id", F.regexp_extract("source_path", r"subject_id=(\d+)", 1).cast("bigint"))
    rows = sensors.normalise_vendor(scanned, "gyroscope", keys=("subject_id",))
    return rounded(rows, 6, elapsed=3, epoc_ms=3)


def _write_recordings(spark, sf_dir, base):
    """Events as canonical files of both sensors."""
    rows = samples(spark, sf_dir).select(
        F.when(F.col("class_label") == 0, "Healthy").otherwise("Stroke").alias("cohort"),
        F.concat(F.lit("Patient_"), F.col("subject_id").cast("string")).alias("subject_id"),
        "side", F.lit(0.0).alias("epoc_ms"), "ts", F.second("ts").cast("double").alias("elapsed"),
        F.col("z").alias("x"), (F.col("z") * 2).alias("y"), "z",
    )
    for sensor in sensors.SENSORS:
        sensors.write_canonical(rows, f"{base}/{sensor}", sensor)


_FILES = """recordings AS (
  SELECT CASE WHEN class_label = 0 THEN 'Healthy' ELSE 'Stroke' END AS cohort, 'Patient_' || subject_id AS subject_id,
         lower('patient_' || subject_id) || '_' || class_label AS patient_id, sensor, side, ts, z, class_label
  FROM signal, (VALUES ('gyroscope'), ('accelerometer')) s(sensor))"""


@query(
    "canonical_file_scan",
    with_(S.SIGNAL, _FILES)
    + "SELECT cohort, subject_id, patient_id, class_label, sensor, side, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, "
    + r("sum(z)", "sum_x", 4) + ", " + r("sum(2 * z)", "sum_y", 4) + ", " + r("sum(z)", "sum_z", 4)
    + " FROM recordings GROUP BY ALL",
)
def canonical_file_scan(spark, sf_dir):
    """Canonical CSV files of all subjects written, then read in one scan with ids from the path."""
    base = stage_path(spark, "recordings")
    _write_recordings(spark, sf_dir, base)
    good, _, _ = sensors.ingest(sensors.scan_canonical(spark, base))
    found = good.groupBy(
        "cohort", "subject_id", sensors.patient_id().alias("patient_id"), sensors.cohort_label().alias("class_label"), "sensor", "side"
    ).agg(
        F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.sum(a).alias(f"sum_{a}") for a in "xyz"],
    )
    return rounded(found, 4)


@query(
    "timestamp_text",
    "SELECT event_id, replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'T', ' '), '.', ':') AS cleaned, ts AS parsed FROM events",
)
def timestamp_text(spark, sf_dir):
    """Time stamps through their text form."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select(
        "event_id", clean_timestamp_text(text).alias("cleaned"), parse_timestamp(text).alias("parsed")
    )


@query(
    "rounded_axes",
    "SELECT event_id, round_even(value / 8 * 1000, 0) / 1000 + 0.0 AS x FROM events",
)
def rounded_axes(spark, sf_dir):
    """Three places, halves to even."""
    return table(spark, sf_dir, "events").select("event_id", round_half_even(F.col("value") / 8).alias("x"))


@query("bracketed_numbers", "SELECT event_id, CAST(trim('[' || CAST(value AS VARCHAR) || ']', '[]') AS DOUBLE) AS v FROM events")
def bracketed_numbers(spark, sf_dir):
    """'[29.27]' read as a number."""
    text = F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", unbracket(text).alias("v"))


@query(
    "stored_tensors",
    "WITH m AS (SELECT vec_id, label, CASE WHEN label < 5 THEN 'Healthy' ELSE 'Stroke' END AS cohort, label % 3 AS label_moderate,"
    " unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT cohort, label_moderate, count(DISTINCT vec_id) AS windows, "
    + r("sum(v)", "total", 4) + " FROM m WHERE label_moderate <> 2 GROUP BY cohort, label_moderate",
)
def stored_tensors(spark, sf_dir):
    """Raw windows stored by cohort and read back without the undefined label."""
    path = stage_path(spark, "tensors")
    rows = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") < 5, "Healthy").otherwise("Stroke").alias("cohort"), (F.col("label") % 3).alias("label_moderate"),
        F.transform(F.sequence(F.lit(0), F.lit(15)),
                    lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 4 + 1, 4)).alias("x"),
    )
    tables.write_tensors(rows, path)
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda acc, v: acc + v)
    found = tables.read_tensors(spark, path, "label_moderate").groupBy("cohort", "label_moderate").agg(
        F.count("*").alias("windows"), F.sum(total).alias("total")
    )
    return rounded(found, 4)


@query(
    "reject_report",
    "SELECT 'Healthy' AS cohort, 'subject_' || (user_id % 10) AS subject_id, 'gyroscope' AS sensor,"
    " CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, 'time stamp without fraction or malformed' AS reason,"
    " count(*) AS lines FROM events WHERE event_type = 'error' GROUP BY ALL",
)
def reject_report(spark, sf_dir):
    """Lines of canonical files whose time text cannot be read (here: error events, written without a fraction)."""
    base, whole = stage_path(spark, "recordings"), "yyyy-MM-dd'T'HH:mm:ss"
    text = F.when(F.col("event_type") == "error", F.date_format("ts", whole)).otherwise(F.date_format("ts", f"{whole}.SSSSSS"))
    rows = table(spark, sf_dir, "events").select(
        F.lit("Healthy").alias("cohort"), F.concat(F.lit("subject_"), (F.col("user_id") % 10).cast("string")).alias("subject_id"),
        F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"), F.lit(0.0).alias("epoc_ms"), text.alias("ts"),
        F.lit(0.0).alias("elapsed"), *[F.col("value").alias(a) for a in "xyz"],
    )
    sensors.write_canonical(rows, base, "gyroscope")
    _, bad, _ = sensors.ingest(sensors.scan_canonical(spark, base))
    return bad
