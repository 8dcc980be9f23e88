"""From canonical sensor rows to the per-window detection datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators import windows
from kinespark.operators.align import zip_rows
from kinespark.plans.classification import bilateral_series
from kinespark.sources.sensors import cohort_label, patient_id
from kinespark.session import stage

SUBJECT = ("cohort", "subject_id")


def sensor_rows(samples: DataFrame, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Both sensors of both sides, paired by position; time stamps are the gyroscope's."""
    def merged(sensor, prefix):
        rows = bilateral_series(samples.filter(F.col("sensor") == sensor).drop("sensor"), keys)
        names = {f"{s}_{a}": f"{prefix}_{s}_{a}" for s in ("left", "right") for a in "xyz"}
        return stage(rows.withColumnsRenamed(names).drop("left_elapsed", "right_elapsed"), prefix)

    return zip_rows(merged("gyroscope", "gyro"), merged("accelerometer", "accel").drop("ts"), keys)


def detection_datasets(samples: DataFrame, fs: float = 100.0, window_s: float = windows.WINDOW_SECONDS,
                       stride_s: float = windows.STRIDE_SECONDS) -> dict[str, DataFrame]:
    """Time-domain, asymmetry and raw datasets of all subjects, from one stored table of windows."""
    found = windows.detection_windows(
        sensor_rows(samples), SUBJECT, int(window_s * fs), int(stride_s * fs), tensor=windows.CHANNELS
    ).select(patient_id().alias("patient_id"), cohort_label().alias("class_label"), "*")
    found = stage(found, "windows")
    ids = ["patient_id", *SUBJECT, "window_id"]
    labels = [*windows.LABELS, "class_label"]
    return {
        "time_domain": found.select(*ids, "start_time", "end_time", *windows.TIME_FEATURES, *labels),
        "asymmetry": found.select(*ids, "start_time", "end_time", *windows.ASYMMETRY_FEATURES, *labels),
        "raw": found.select(*ids, "x", *labels),
    }


def without_windows(samples: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Subjects too short for a single window."""
    some = datasets["time_domain"].select(*SUBJECT).distinct()
    return samples.select(*SUBJECT).distinct().join(some, list(SUBJECT), "left_anti").withColumn(
        "reason", F.lit("shorter than one window")
    )


def defined(dataset: DataFrame, label: str) -> DataFrame:
    """Windows whose label is 0 or 1."""
    return dataset.filter(F.col(label).isin(0, 1))
