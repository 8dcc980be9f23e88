"""Sensor files: scanning, normalising, and writing.

Canonical files lie at ``<base>/<cohort>/<subject>/<Left|Right>Shank-<Gyroscope|Accelerometer>.csv``.
Cohort, subject, side and sensor come from the path, so one scan reads all subjects in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.functions.scalar import (
    clean_timestamp_text, epoch_millis, nan_to_null, parse_timestamp, plus_seconds, round_half_even,
)
from kinespark.operators.dataset import missing_sources
from kinespark.operators.layout import attach
from kinespark.session import stage

SENSORS = ("gyroscope", "accelerometer")
SIDES = ("left", "right")
KEYS = ("cohort", "subject_id", "sensor", "side")

# Column names of the files.
UNITS = {"gyroscope": "deg/s", "accelerometer": "g"}
VENDOR_AXES = {"gyroscope": ("Gyro1x", "Gyro1y", "Gyro1z"), "accelerometer": ("X", "Y", "Z")}
BASE_TIME = "2024-08-21 09:35:00"
HEALTHY = "Healthy"

_DOUBLE, _STRING = T.DoubleType(), T.StringType()


def vendor_schema(sensor: str) -> T.StructType:
    """Raw export: an unnamed index first, then the axes, the time text and a counter in milliseconds."""
    fields = [("_c0", T.LongType())] + [(a, _DOUBLE) for a in VENDOR_AXES[sensor]]
    fields += [("Time", _STRING), ("microsecond", _DOUBLE)]
    if sensor == "gyroscope":
        fields.append(("elasped_time", _DOUBLE))
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The three axes are read under unit-free names: a scan with this schema covers both sensors.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("epoc_ms", _DOUBLE), T.StructField("timestamp_text", _STRING), T.StructField("elapsed", _DOUBLE),
        T.StructField("x", _DOUBLE), T.StructField("y", _DOUBLE), T.StructField("z", _DOUBLE),
        T.StructField("_bad_line", _STRING),
    ]
)


def canonical_columns(sensor: str) -> list[str]:
    return ["epoc (ms)", "timestamp (+0700)", "elapsed (s)"] + [f"{a}-axis ({UNITS[sensor]})" for a in "xyz"]


def scan_vendor(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    """Raw export file(s) without the index column, plus ``source_path``; the index orders the rows as ``row_no``."""
    rows = spark.read.schema(vendor_schema(sensor)).csv(path, header=True)
    return rows.select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_c0").alias("row_no"), *rows.columns[1:]
    )


def normalise_vendor(rows: DataFrame, sensor: str, base: str = BASE_TIME, keys: tuple[str, ...] = ("source_path",)) -> DataFrame:
    """Vendor rows as canonical rows.

    Elapsed seconds count from the file's first row, the time stamp is ``base`` plus that, and the
    axes are rounded to three places.
    """
    first = rows.groupBy(*keys).agg(F.min_by("microsecond", "row_no").alias("_first"))
    elapsed = (F.col("microsecond") - F.col("_first")) / 1000
    stamped = attach(rows, first, keys, "row_no").withColumn("elapsed", elapsed)
    stamped = stamped.withColumn("ts", plus_seconds(F.lit(base).cast("timestamp_ntz"), "elapsed"))
    return stamped.select(
        *keys,
        "row_no",
        epoch_millis("ts").alias("epoc_ms"),
        "ts",
        "elapsed",
        *[round_half_even(v).alias(a) for a, v in zip("xyz", VENDOR_AXES[sensor])],
    )


def as_canonical_file(rows: DataFrame, sensor: str) -> DataFrame:
    """Columns under the names and in the order of a canonical file."""
    columns = ["epoc_ms", "ts", "elapsed", "x", "y", "z"]
    return rows.select(*[F.col(c).alias(f) for c, f in zip(columns, canonical_columns(sensor))])


def _path_parts() -> Column:
    """[cohort, subject, file] from the path of a file, or of a part of a folder, with or without ``name=`` prefixes."""
    # '+' is literal in a path, but url_decode would read it as a blank
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    plain = F.element_at(parts, -1).contains("Shank-")
    last_three = F.when(plain, F.slice(parts, -3, 3)).otherwise(F.slice(parts, -4, 3))
    return F.transform(last_three, lambda p: F.substring_index(p, "=", -1))


_FILE_NAME = r"^(Left|Right)Shank-(Gyroscope|Accelerometer)\.csv$"


def scan_canonical(spark: SparkSession, base: str) -> DataFrame:
    """All canonical files under ``base`` as rows; lines that cannot be used carry a ``reason``."""
    rows = (
        spark.read.schema(CANONICAL_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad_line")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(base)
        .withColumn("_parts", _path_parts())
    )
    file = F.col("_parts")[2]
    rows = rows.withColumn("_ts", parse_timestamp("timestamp_text"))
    ts = F.col("_ts")
    reason = F.when(F.col("_bad_line").isNotNull(), "line does not match the schema").when(
        ts.isNull(), "time stamp without fraction or malformed"
    )
    return rows.filter(file.rlike(_FILE_NAME)).select(
        F.col("_parts")[0].alias("cohort"),
        F.col("_parts")[1].alias("subject_id"),
        F.when(file.contains("Gyroscope"), "gyroscope").otherwise("accelerometer").alias("sensor"),
        F.when(file.startswith("Left"), "left").otherwise("right").alias("side"),
        clean_timestamp_text("timestamp_text").alias("timestamp_text"),
        ts.alias("ts"),
        nan_to_null("elapsed").alias("elapsed"),
        *[nan_to_null(a).alias(a) for a in "xyz"],
        reason.alias("reason"),
    )


def cohort_label(cohort: str | Column = "cohort") -> Column:
    """0 for the healthy cohort, 1 for any other."""
    cohort = F.col(cohort) if isinstance(cohort, str) else cohort
    return F.when(cohort.contains(HEALTHY), 0).otherwise(1)


def patient_id() -> Column:
    """'Patient_5' of the healthy cohort → 'patient_5_0'."""
    return F.concat_ws("_", F.lower("subject_id"), cohort_label().cast("string"))


def split_rejects(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of subjects whose files are all usable, and one reject row per (subject, source, reason).

    A subject with a bad file is left out whole, as a failed subject is, and the run goes on.
    """
    bad = scanned.filter(F.col("reason").isNotNull()).groupBy(*KEYS, "reason").agg(F.count("*").alias("lines"))
    subjects = bad.select("cohort", "subject_id").distinct()
    good = scanned.filter(F.col("reason").isNull()).drop("reason", "timestamp_text")
    # one row per failed subject; AQE picks the join by its measured size
    return good.join(subjects, ["cohort", "subject_id"], "left_anti"), bad


def ingest(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse the files once: good rows and reject report as of :func:`split_rejects`, and the counts of the scan.

    The lines are stored with their reasons by the only job that reads the files. Everything else, the counts too (one row
    per recording: ``lines``, and how many of them are ``rejected``), comes from a few columns of the stored table. (An
    observation on the writing job would do for the counts, but a session that holds one can no longer ship fitted
    models to its tasks.)
    """
    stored = stage(scanned, "lines")
    good, bad = split_rejects(stored)
    counts = stored.groupBy(*KEYS).agg(F.count("*").alias("lines"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return good, bad, counts


def missing_files(scanned: DataFrame, sensors: tuple[str, ...] = SENSORS) -> DataFrame:
    """Required (subject, sensor, side) files that no row came from."""
    subjects = scanned.select("cohort", "subject_id").distinct()
    expected = subjects.withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in sensors]))).withColumn(
        "side", F.explode(F.array(*[F.lit(s) for s in SIDES]))
    )
    return missing_sources(expected, scanned, KEYS, "file not found")


def write_canonical(rows: DataFrame, base: str, sensor: str) -> None:
    """Write canonical CSV files, one folder per cohort, subject and file; replaces what is there.

    Rows are dealt by ranges of (recording, time): there are at most as many files as recordings and
    ranges together, each in the order of time, and a long recording is spread over several ranges.
    """
    name = F.concat(F.initcap("side"), F.lit(f"Shank-{sensor.capitalize()}.csv"))
    out = rows.select(
        "cohort", "subject_id", name.alias("file"),
        *[F.col(c).alias(f) for c, f in zip(["epoc_ms", "ts", "elapsed", "x", "y", "z"], canonical_columns(sensor))],
    )
    order = ["cohort", "subject_id", "file", canonical_columns(sensor)[1]]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("overwrite").partitionBy("cohort", "subject_id", "file").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).csv(base, header=True)
