"""From CSV folders to both datasets."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kinespark.functions import scalar
from kinespark.operators import dataset
from kinespark.plans import detection
from kinespark.plans.classification import FeatureSettings, bilateral_series, long_series, subject_features
from kinespark.session import stage
from kinespark.sources import sensors, tables

START = dt.datetime(2024, 8, 21, 9, 35)


def write_file(base, cohort, subject, side, sensor, rows, offset_ms=0, values=None):
    folder = os.path.join(base, cohort, subject)
    os.makedirs(folder, exist_ok=True)
    unit = sensors.UNITS[sensor.lower()]
    with open(os.path.join(folder, f"{side}Shank-{sensor}.csv"), "w") as f:
        f.write("epoc (ms),timestamp (+0700),elapsed (s)," + ",".join(f"{a}-axis ({unit})" for a in "xyz") + "\n")
        for i in range(rows):
            ts = START + dt.timedelta(milliseconds=10 * i + offset_ms)
            z = values[i] if values else ((i * 7) % 23) - 9 + (i % 5)
            f.write(f"{i},{ts.isoformat(timespec='milliseconds')},{i / 100},{i % 7},{i % 11},{z}\n")


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("Data"))
    for cohort, subject, rows in (("Healthy", "Patient_5", 620), ("Stroke", "Patient_5", 540), ("Stroke", "Patient 7+", 450)):
        for sensor in ("Gyroscope", "Accelerometer"):
            write_file(base, cohort, subject, "Left", sensor, rows)
            write_file(base, cohort, subject, "Right", sensor, rows - 20, offset_ms=20)
    write_file(base, "Stroke", "Patient_9", "Left", "Gyroscope", 150)
    bad = os.path.join(base, "Healthy", "Patient_8")
    write_file(base, "Healthy", "Patient_8", "Left", "Gyroscope", 30)
    with open(os.path.join(bad, "LeftShank-Gyroscope.csv"), "a") as f:
        f.write("1,2024-08-21T09:36:00,0.1,1,2,3\n")
    return base


def test_scan_takes_ids_from_the_path_and_sets_bad_subjects_apart(spark, recordings):
    scanned = sensors.scan_canonical(spark, recordings)
    good, bad = sensors.split_rejects(scanned)
    assert [(r["cohort"], r["subject_id"], r["side"], r["lines"]) for r in bad.collect()] == [("Healthy", "Patient_8", "left", 1)]
    counts = {tuple(r)[:4]: r["count"] for r in good.groupBy(*sensors.KEYS).count().collect()}
    assert counts[("Stroke", "Patient 7+", "accelerometer", "right")] == 430
    assert not any(k[1] == "Patient_8" for k in counts)
    ids = {r[0] for r in good.select(sensors.patient_id()).distinct().collect()}
    assert {"patient_5_0", "patient_5_1"} <= ids
    missing = {tuple(r)[:4] for r in sensors.missing_files(good).collect()}
    assert missing == {("Stroke", "Patient_9", s, d) for s in sensors.SENSORS for d in sensors.SIDES} - {
        ("Stroke", "Patient_9", "gyroscope", "left")}


def test_files_are_read_once(spark, recordings):
    good, bad, counts = sensors.ingest(sensors.scan_canonical(spark, recordings))
    for table in (good, bad, counts):
        assert "csv" not in table._jdf.queryExecution().toString().lower().replace(".csv", "")
    expected_good, expected_bad = sensors.split_rejects(sensors.scan_canonical(spark, recordings))
    assert sorted(bad.collect()) == sorted(expected_bad.collect())
    assert good.count() == expected_good.count() and good.columns == expected_good.columns
    seen = {tuple(r)[:4]: (r["lines"], r["rejected"]) for r in counts.collect()}
    scanned = sensors.scan_canonical(spark, recordings).groupBy(*sensors.KEYS).count().collect()
    assert {tuple(r)[:4]: r["count"] for r in scanned} == {k: n for k, (n, _) in seen.items()}
    assert [k for k, (_, n) in seen.items() if n] == [("Healthy", "Patient_8", "gyroscope", "left")]


def test_shape_of_a_written_table(spark, tmp_path):
    df = spark.range(57).selectExpr("id", "id % 3 AS k")
    report = dataset.write_with_shape(df, str(tmp_path / "t"), "numbers")
    assert [tuple(r) for r in report.collect()] == [("numbers", 57, 2)] == [tuple(r) for r in dataset.shape_report(df, "numbers").collect()]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 57


def test_missing_folder_is_an_error(spark, recordings):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sensors.scan_canonical(spark, recordings + "/nowhere").count()


def test_detection_datasets_from_files(spark, recordings, tmp_path):
    good, _ = sensors.split_rejects(sensors.scan_canonical(spark, recordings))
    good = stage(good)
    found = detection.detection_datasets(good)
    counts = {r["patient_id"]: r["count"] for r in found["time_domain"].groupBy("patient_id").count().collect()}
    # right starts 2 rows late and ends with left: 618, 538 and 448 merged rows
    assert counts == {"patient_5_0": 5, "patient_5_1": 4, "patient 7+_1": 3}
    assert found["asymmetry"].count() == 12
    raw = found["raw"].select(F.size("x").alias("rows"), F.size(F.col("x")[0]).alias("channels")).distinct().collect()
    assert [tuple(r) for r in raw] == [(200, 12)]
    short = detection.without_windows(good, found).collect()
    assert [(r["subject_id"], r["reason"]) for r in short] == [("Patient_9", "shorter than one window")]

    path = str(tmp_path / "raw")
    tables.write_tensors(found["raw"], path)
    stored = tables.read_tensors(spark, path)
    assert stored.count() == 12 and set(stored.columns) == set(found["raw"].columns)
    assert tables.read_tensors(spark, path, "label_moderate").count() == detection.defined(found["raw"], "label_moderate").count()


def test_subject_dataset_from_files(spark, recordings):
    good, _ = sensors.split_rejects(sensors.scan_canonical(spark, recordings))
    keys = ["cohort", "subject_id"]
    spine = good.select(*keys).distinct().withColumn("label", sensors.cohort_label())
    gyro = good.filter("sensor = 'gyroscope'").drop("sensor")
    series = stage(long_series(bilateral_series(gyro, keys), keys))
    record = stage(subject_features(series, spine, keys, FeatureSettings()))
    assert len(record.columns) == 3 + 56
    rows = {(r["cohort"], r["subject_id"]): r for r in record.collect()}
    assert len(rows) == 4
    assert rows[("Stroke", "Patient_9")]["left_z_mean"] is None
    row = rows[("Healthy", "Patient_5")]
    z = [((i * 7) % 23) - 9 + (i % 5) for i in range(620)][2:]
    assert row["label"] == 0 and row["left_z_mean"] == pytest.approx(sum(z) / len(z))
    assert row["asymmetry_index"] is not None and row["left_gait_band_energy_mean"] > 0


def test_vendor_file(spark, tmp_path):
    path = str(tmp_path / "gyro.csv")
    with open(path, "w") as f:
        f.write(",Gyro1x,Gyro1y,Gyro1z,Time,microsecond,elasped_time\n")
        f.write("0,1.00049,2.0015,-3.0005,09:35,500,0\n1,1.5,2.5,3.5,09:35,512.5,0\n")
    rows = sensors.normalise_vendor(sensors.scan_vendor(spark, path, "gyroscope"), "gyroscope").orderBy("row_no").collect()
    assert [r["elapsed"] for r in rows] == [0.0, 0.0125]
    assert rows[1]["ts"] == START + dt.timedelta(microseconds=12_500)
    assert rows[0]["epoc_ms"] == 1724232900000.0
    assert (rows[0]["x"], rows[0]["z"]) == (1.0, -3.0)
    columns = sensors.as_canonical_file(sensors.normalise_vendor(sensors.scan_vendor(spark, path, "gyroscope"), "gyroscope"), "gyroscope").columns
    assert columns == ["epoc (ms)", "timestamp (+0700)", "elapsed (s)", "x-axis (deg/s)", "y-axis (deg/s)", "z-axis (deg/s)"]


def test_scalar_functions(spark):
    df = spark.sql("SELECT ' 2024-08-21T09:35:00.01 ' AS t, '2024-08-21 09:35:00' AS whole, '[0.25]' AS b, double('NaN') AS nan")
    row = df.select(
        scalar.parse_timestamp("t").alias("ts"), scalar.parse_timestamp("whole").alias("none"), scalar.unbracket("b").alias("b"),
        scalar.nan_to_null("nan").alias("nan"), scalar.round_half_even(F.lit(2.5), 0).alias("even"),
        scalar.percent_difference(F.lit(0.0), F.lit(0.0)).alias("zero"),
    ).first()
    assert row["ts"] == dt.datetime(2024, 8, 21, 9, 35, 0, 10_000)
    assert (row["none"], row["b"], row["nan"], row["even"], row["zero"]) == (None, 0.25, None, 2.0, None)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert constant.agg(scalar.correlation("x", "y")).first()[0] is None


def test_csv_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    tables.write_csv(df, str(tmp_path / "report"))
    tables.write_csv(df, str(tmp_path / "report"))
    assert tables.read_csv(spark, str(tmp_path / "report"), "model string, accuracy double").collect() == df.collect()
