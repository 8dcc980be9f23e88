"""Queries over aligned sides, sliding windows and assembled datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinespark.operators import align, dataset, gait, spectra, windows
from kinespark.operators.layout import enumerate_rows
from kinespark.plans import series_queries as sq
from kinespark.plans import sql_parts as S
from kinespark.plans.classification import FeatureSettings, subject_features
from kinespark.plans.registry import query, r, rounded, with_
from kinespark.plans.views import (
    SERIES, SUBJECT, bilateral_full, bilateral_grid, samples, signal_long, staged_signal, supplier_series, table, two_sensors,
)
from kinespark.session import stage

_MERGED = (S.SIGNAL, S.GRID, S.MERGED)


@query("bilateral_merge", with_(*_MERGED) + "SELECT subject_id, hour_no, left_z, right_z, CAST(n AS BIGINT) AS n FROM merged")
def bilateral_merge(spark, sf_dir):
    """Full outer join of both sides on the time key, forward-filled in time order."""
    return bilateral_grid(spark, sf_dir)


_ASOF = "SELECT subject_id, ts, left_z, right_z, CAST(n AS BIGINT) AS n FROM merged"


@query("asof_merge", with_(S.SIGNAL, S.asof("signal", "merged")) + _ASOF)
def asof_merge(spark, sf_dir):
    """Both sides at full rate: every time stamp of either with the last values of both."""
    return bilateral_full(samples(spark, sf_dir))


@query("asof_merge_within", with_(S.SIGNAL, S.asof("signal", "merged", "INTERVAL 30 MINUTE")) + _ASOF)
def asof_merge_within(spark, sf_dir):
    """The same, where values of more than half an hour ago count as missing."""
    return bilateral_full(samples(spark, sf_dir), F.expr("INTERVAL 30 MINUTES"))


@query(
    "complete_bilateral_rows",
    with_(S.SIGNAL, S.asof("signal", "merged"), S.complete("merged", "whole"))
    + "SELECT subject_id, ts, left_z, right_z, n FROM whole",
)
def complete_bilateral_rows(spark, sf_dir):
    """The merged series without its incomplete head, numbered again."""
    return align.complete_rows(bilateral_full(samples(spark, sf_dir)), SUBJECT)


@query(
    "sensor_rows_by_position",
    with_(*S.TWO_SENSORS) + "SELECT subject_id, CAST(n AS BIGINT) AS n, ts, "
    + ", ".join(r(f"{sensor}_{side}_z", f"{sensor}_{side}_z") for sensor in ("gyro", "accel") for side in ("left", "right"))
    + " FROM both_sensors",
)
def sensor_rows_by_position(spark, sf_dir):
    """Gyroscope row i next to accelerometer row i, cut to the shorter series."""
    return rounded(two_sensors(spark, sf_dir))


@query(
    "common_interval",
    with_(
        S.SIGNAL,
        """timed AS (
  SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY subject_id)) / 1000000.0 AS elapsed FROM signal),
ends AS (SELECT subject_id, side, min(elapsed) AS f, max(elapsed) AS l FROM timed GROUP BY subject_id, side),
shared AS (SELECT subject_id, max(f) AS s, min(l) AS e FROM ends GROUP BY subject_id)""",
    )
    + "SELECT subject_id, side, event_id, " + r("elapsed - s", "synced")
    + " FROM timed JOIN shared USING (subject_id) WHERE elapsed >= s AND elapsed <= e",
)
def common_interval(spark, sf_dir):
    """Both sides clipped to the time they share."""
    rows = samples(spark, sf_dir)
    first = rows.groupBy(*SUBJECT).agg(F.min("ts").alias("_t0"))
    micros = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts"))
    timed = align.attach(rows, first, SUBJECT, "event_id").withColumn("elapsed", micros / 1_000_000)
    clipped = align.common_interval(timed, SUBJECT, pos="elapsed")
    return rounded(clipped.select("subject_id", "side", "event_id", "synced"))


_SLIDING = """cut AS (
  SELECT b.*, w.window_id FROM both_sensors b
  JOIN (SELECT DISTINCT n // 100 AS window_id FROM both_sensors) w
    ON b.n BETWEEN w.window_id * 100 AND w.window_id * 100 + 199),
windows AS (
  SELECT subject_id, window_id, min(ts) AS start_time, max(ts) AS end_time,
         max(gyro_right_z) AS gyro_right_z_max, min(gyro_right_z) AS gyro_right_z_min,
         max(gyro_left_z) AS gyro_left_z_max, min(gyro_left_z) AS gyro_left_z_min,
         max(accel_right_z) AS accel_right_z_max, min(accel_right_z) AS accel_right_z_min,
         max(accel_left_z) AS accel_left_z_max, min(accel_left_z) AS accel_left_z_min
  FROM cut GROUP BY subject_id, window_id HAVING count(*) = 200),
window_series AS (
  SELECT subject_id, window_id, 'left' AS side, n, gyro_left_z AS z FROM cut JOIN windows USING (subject_id, window_id)
  UNION ALL
  SELECT subject_id, window_id, 'right', n, gyro_right_z FROM cut JOIN windows USING (subject_id, window_id))"""
_WK = "subject_id, window_id, side"


def _window_labels(keys: str = "subject_id, window_id") -> str:
    """Pairs of strides per window, their means and the three labels of the first pair."""
    on = " AND ".join(f"l.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    lk = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    return f"""window_pairs AS (
  SELECT {lk}, l.stride_no,
         (l.stride_samples - r.stride_samples) / CAST(l.stride_samples + r.stride_samples AS DOUBLE) AS a,
         least(l.stride_samples, r.stride_samples) / CAST(greatest(l.stride_samples, r.stride_samples) AS DOUBLE) AS s
  FROM window_strides l JOIN window_strides r ON {on} AND l.stride_no = r.stride_no AND l.side = 'left' AND r.side = 'right'),
window_labels AS (
  SELECT {keys}, avg(a) AS a, avg(s) AS s, max(CASE WHEN stride_no = 0 THEN abs(a) END) AS a0,
         max(CASE WHEN stride_no = 0 THEN s END) AS s0
  FROM window_pairs GROUP BY {keys})"""


def _label_columns() -> str:
    return ", ".join(
        f"CASE WHEN a0 IS NULL THEN 2 WHEN a0 > CAST({high} AS DOUBLE) OR s0 < CAST({low} AS DOUBLE) THEN 1 ELSE 0 END"
        f" AS label_{name}"
        for name, (high, low) in windows.LABEL_LIMITS.items()
    )


DETECTION_SQL = (
    *S.TWO_SENSORS, _SLIDING,
    S.maxima("window_series", _WK, height=windows.PEAK_HEIGHT, out="window_tops"),
    S.thinned("window_tops", _WK, windows.PEAK_DISTANCE, out="window_peaks"),
    S.numbered_strides("window_peaks", _WK, out="window_strides"),
    _window_labels(),
)


def detection(spark, sf_dir, tensor=(), columns="z"):
    return windows.detection_windows(two_sensors(spark, sf_dir, columns), SUBJECT, tensor=tensor)


_CLASS = "CASE WHEN subject_id < 5 THEN 0 ELSE 1 END AS class_label"


def _class_label():
    return F.when(F.col("subject_id") < 5, 0).otherwise(1).alias("class_label")


@query(
    "detection_time_domain",
    with_(*DETECTION_SQL, recursive=True)
    + "SELECT subject_id, CAST(window_id AS BIGINT) AS window_id, start_time, end_time, "
    + ", ".join(r(c, c) for c in windows.TIME_FEATURES) + f", {_label_columns()}, {_CLASS}"
    + " FROM windows LEFT JOIN window_labels USING (subject_id, window_id)",
)
def detection_time_domain(spark, sf_dir):
    """Extremes and labels of every full window of 200 rows."""
    found = detection(spark, sf_dir).drop(*windows.ASYMMETRY_FEATURES)
    return rounded(found.select("*", _class_label()))


@query(
    "detection_asymmetry",
    with_(*DETECTION_SQL, recursive=True)
    + "SELECT subject_id, CAST(window_id AS BIGINT) AS window_id, start_time, end_time, "
    + r("a", "gyro_asymmetry_stride_times") + ", " + r("s", "gyro_symmetry_ratio_stride_times")
    + f", {_label_columns()}, {_CLASS} FROM windows LEFT JOIN window_labels USING (subject_id, window_id)",
)
def detection_asymmetry(spark, sf_dir):
    """Mean stride asymmetry and symmetry and labels of every full window."""
    found = detection(spark, sf_dir).drop(*windows.TIME_FEATURES)
    return rounded(found.select("*", _class_label()))


_TENSOR = ["gyro_left_z", "gyro_right_z", "accel_left_z", "accel_right_z"]


def _sums_sql(channels: list[str]) -> str:
    return (
        f"SELECT subject_id, CAST(window_id AS BIGINT) AS window_id, CAST(200 AS INTEGER) AS samples, CAST({len(channels)} AS INTEGER) AS channels, "
        + ", ".join(r(f"sum({c} * (n - window_id * 100 + 1))", f"sum_{c}", 4) for c in channels)
        + " FROM cut SEMI JOIN windows USING (subject_id, window_id) GROUP BY subject_id, window_id"
    )


def _weighted_sums(found, channels):
    """Position-weighted sums of every channel of the raw matrices."""
    def weighted(channel):
        terms = F.transform("x", lambda row, i: row[channel] * (i + 1))
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    return rounded(
        found.select(
            "subject_id", "window_id", F.size("x").alias("samples"), F.size(F.get("x", F.lit(0))).alias("channels"),
            *[weighted(i).alias(f"sum_{c}") for i, c in enumerate(channels)],
        ),
        4,
    )


@query("detection_raw_windows", with_(*S.TWO_SENSORS, _SLIDING) + _sums_sql(_TENSOR))
def detection_raw_windows(spark, sf_dir):
    """Raw samples × channels matrix of every full window, reduced to position-weighted sums."""
    return _weighted_sums(detection(spark, sf_dir, _TENSOR), _TENSOR)


@query("detection_tensors", with_(*S.TWELVE, _SLIDING) + _sums_sql(windows.CHANNELS))
def detection_tensors(spark, sf_dir):
    """The same with all twelve channels: three axes of both sensors on both sides."""
    return _weighted_sums(detection(spark, sf_dir, windows.CHANNELS, "xyz"), windows.CHANNELS)


# suppliers as subjects: four columns of the same rows stand for both sides of both sensors
_SUPPLIER_BOTH = """both_sensors AS (
  SELECT l_suppkey AS subject_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS n,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS ts,
         CAST(l_quantity AS DOUBLE) - 25.5 AS gyro_left_z, CAST(l_extendedprice AS DOUBLE) / 1000 - 25 AS gyro_right_z,
         CAST(l_discount AS DOUBLE) AS accel_left_z, CAST(l_tax AS DOUBLE) AS accel_right_z
  FROM lineitem)"""


@query(
    "detection_windows_by_supplier",
    with_(_SUPPLIER_BOTH, *DETECTION_SQL[-5:], recursive=True)
    + "SELECT subject_id AS l_suppkey, CAST(window_id AS BIGINT) AS window_id, "
    + ", ".join(r(c, c) for c in windows.TIME_FEATURES) + ", "
    + r("a", "gyro_asymmetry_stride_times") + ", " + r("s", "gyro_symmetry_ratio_stride_times") + f", {_label_columns()}"
    + " FROM windows LEFT JOIN window_labels USING (subject_id, window_id)",
)
def detection_windows_by_supplier(spark, sf_dir):
    """Detection features and labels for many series."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber",
        (F.col("l_quantity").cast("double") - 25.5).alias("gyro_left_z"),
        (F.col("l_extendedprice").cast("double") / 1000 - 25).alias("gyro_right_z"),
        F.col("l_discount").cast("double").alias("accel_left_z"),
        F.col("l_tax").cast("double").alias("accel_right_z"),
    )
    numbered = enumerate_rows(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    found = windows.detection_windows(numbered, ["l_suppkey"], time="n")
    return rounded(found.drop("start_time", "end_time"))


@query(
    "sliding_window_extremes",
    with_(
        S.SUPPLIERS,
        """cut AS (
  SELECT l_suppkey, n, z, w.window_id FROM suppliers JOIN (SELECT DISTINCT n // 100 AS window_id FROM suppliers) w
    ON n BETWEEN w.window_id * 100 AND w.window_id * 100 + 199)""",
    )
    + "SELECT l_suppkey, CAST(window_id AS BIGINT) AS window_id, max(z) AS z_max, min(z) AS z_min FROM cut"
    " GROUP BY l_suppkey, window_id HAVING count(*) = 200",
)
def sliding_window_extremes(spark, sf_dir):
    """Maximum and minimum of every full window of 200 rows, step 100."""
    cut = windows.sliding_windows(supplier_series(spark, sf_dir).select("l_suppkey", "n", "z"))
    found = cut.groupBy("l_suppkey", "window_id").agg(
        F.max("z").alias("z_max"), F.min("z").alias("z_min"), F.count("*").alias("_rows")
    )
    return found.filter(F.col("_rows") == 200).drop("_rows")


_CELLS = """cells AS (
  SELECT vec_id, i // 4 AS sample, i % 4 AS channel, v FROM (
    SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
fitted AS (SELECT channel, avg(v) AS mean, stddev_pop(v) AS std FROM cells GROUP BY channel)"""


def _matrices(spark, sf_dir):
    """Each embedding of 64 values as a matrix of 16 samples × 4 channels."""
    values = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(values, i * 4 + 1, 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("x"))


@query(
    "channel_statistics",
    with_(_CELLS) + "SELECT CAST(channel AS INTEGER) AS channel, " + r("mean", "mean", 9) + ", " + r("std", "std", 9) + " FROM fitted",
)
def channel_statistics(spark, sf_dir):
    return rounded(windows.channel_statistics(_matrices(spark, sf_dir)), 9)


@query(
    "normalised_channels",
    with_(_CELLS) + "SELECT vec_id, CAST(sample AS INTEGER) AS sample, CAST(channel AS INTEGER) AS channel, "
    + r("(v - mean) / (std + 1e-7)", "v") + " FROM cells JOIN fitted USING (channel)",
)
def normalised_channels(spark, sf_dir):
    """Raw matrices scaled per channel over all windows and samples."""
    raw = _matrices(spark, sf_dir)
    scaled = windows.normalise_channels(raw, windows.channel_statistics(raw))
    cells = scaled.select("vec_id", F.posexplode("x").alias("sample", "_row"))
    return rounded(cells.select("vec_id", "sample", F.posexplode("_row").alias("channel", "v")))


@query(
    "flattened_windows",
    "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos"
    " FROM embeddings",
)
def flattened_windows(spark, sf_dir):
    """Samples × channels back to one long vector."""
    flat = _matrices(spark, sf_dir).select("vec_id", F.flatten("x").alias("x"))
    return flat.select("vec_id", F.posexplode("x").alias("pos", "v"))


_SPINE = "spine AS (SELECT DISTINCT subject_id, class_label AS label FROM signal)"


def _dataset_sql() -> str:
    energy = {c: 3 for c in _energy_columns()}
    parts = (
        *sq.SPECTRA_SQL, sq._statistics("signal", sq.KEYS), *sq._THINNED[1:], S.numbered_strides("thinned", sq.KEYS),
        sq._PAIRS, *sq._CYCLES, sq._CROSS, _SPINE,
        f"time_part AS (SELECT subject_id, {sq._wide_statistics()} FROM stats GROUP BY subject_id)",
        "spectral_part AS (SELECT subject_id, "
        + ", ".join(
            r(f"{fn}(CASE WHEN side = '{s}' THEN {f} END)", f"{s}_{f}_{suffix}", energy.get(f"{s}_{f}_{suffix}", 6))
            for s in ("left", "right") for f in spectra.FEATURES for fn, suffix in (("avg", "mean"), ("stddev_samp", "std"))
        )
        + " FROM spectra GROUP BY subject_id)",
        "symmetry_part AS (SELECT subject_id, " + r("avg(a)", "asymmetry_index") + ", " + r("avg(s)", "symmetry_ratio")
        + " FROM pairs GROUP BY subject_id)",
        "limb_part AS (SELECT subject_id, "
        + ", ".join(r(f"avg({c})", f"{c}_mean") + ", " + r(f"stddev_samp({c})", f"{c}_std") for c in gait.CROSS_LIMB)
        + " FROM cross_limb GROUP BY subject_id)",
    )
    return with_(*parts, recursive=True) + (
        "SELECT * FROM spine LEFT JOIN time_part USING (subject_id) LEFT JOIN spectral_part USING (subject_id)"
        " LEFT JOIN symmetry_part USING (subject_id) LEFT JOIN limb_part USING (subject_id)"
    )


def _energy_columns():
    return [f"{s}_gait_band_energy_{m}" for s in ("left", "right") for m in ("mean", "std")]


def subject_dataset_raw(spark, sf_dir):
    series = staged_signal(spark, sf_dir).withColumn("elapsed", F.col("n") / sq.FS)
    spine = series.select("subject_id", F.col("class_label").alias("label")).distinct()
    settings = FeatureSettings(
        fs=sq.FS, window_s=sq.SPECTRAL_WIDTH, stride_height=sq.PEAK_HEIGHT, stride_distance=sq.PEAK_DISTANCE
    )
    return subject_features(series, spine, SUBJECT, settings)


@query("subject_dataset", _dataset_sql())
def subject_dataset(spark, sf_dir):
    """The classification table: 56 features, subject and label."""
    return rounded(subject_dataset_raw(spark, sf_dir), **{c: 3 for c in _energy_columns()})


@query(
    "cohort_union",
    with_(S.SIGNAL)
    + "SELECT subject_id, class_label, max(CASE WHEN class_label = 0 THEN z END) AS healthy_max,"
    " min(CASE WHEN class_label = 1 THEN z END) AS stroke_min FROM signal GROUP BY subject_id, class_label",
)
def cohort_union(spark, sf_dir):
    """Two cohort tables with partly different columns as one."""
    rows = samples(spark, sf_dir)
    healthy = rows.filter("class_label = 0").groupBy("subject_id", "class_label").agg(F.max("z").alias("healthy_max"))
    stroke = rows.filter("class_label = 1").groupBy("subject_id", "class_label").agg(F.min("z").alias("stroke_min"))
    return dataset.cohort_union([healthy, stroke])


@query(
    "shape_report",
    with_(S.SIGNAL) + "SELECT 'samples' AS table_name, count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM signal",
)
def shape_report(spark, sf_dir):
    return dataset.shape_report(samples(spark, sf_dir), "samples")


@query(
    "first_rows",
    with_(S.SIGNAL) + "SELECT subject_id, side, event_id, ts, z FROM signal ORDER BY ts, event_id LIMIT 5",
)
def first_rows(spark, sf_dir):
    """The first five samples."""
    return samples(spark, sf_dir).drop("class_label").orderBy("ts", "event_id").limit(5)


@query(
    "missing_sources",
    "WITH present AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM events), "
    "spans AS (SELECT user_id, min(day) AS a, max(day) AS b FROM present GROUP BY user_id), "
    "spine AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, side FROM spans, (VALUES ('left'), ('right')) s(side)) "
    "SELECT user_id, day, side, 'no samples' AS reason FROM spine ANTI JOIN present USING (user_id, day, side)",
)
def missing_sources(spark, sf_dir):
    """Days between a user's first and last one on which a side has no samples."""
    seen = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side")
    )
    spans = seen.groupBy("user_id").agg(F.sequence(F.min("day"), F.max("day")).alias("days"))
    expected = spans.select("user_id", F.explode("days").alias("day")).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return dataset.missing_sources(expected, seen, ["user_id", "day", "side"], "no samples")
