import numpy as np
import pytest
from helpers import greedy, maxima
from pyspark.sql import functions as F

from kinespark.operators import windows
from kinespark.operators.windows import LABEL_LIMITS


def wide(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    data = {k: rng.integers(-3, 8, (4, size)).astype(float) for k, size in lengths.items()}
    rows = [(k, n, n, *[float(v) for v in z[:, n]]) for k, z in data.items() for n in range(z.shape[1])]
    names = "gyro_left_z double, gyro_right_z double, accel_left_z double, accel_right_z double"
    return data, spark.createDataFrame(rows, f"key string, n long, ts long, {names}")


def test_number_of_windows(spark):
    _, df = wide(spark, {"199": 199, "200": 200, "300": 300, "399": 399})
    found = windows.detection_windows(df, ["key"])
    counts = {r["key"]: r["count"] for r in found.groupBy("key").count().collect()}
    assert counts == {"200": 1, "300": 2, "399": 2}


@pytest.mark.parametrize("rows,step,distance", [(200, 100, 80), (50, 20, 8), (60, 60, 5)])
def test_features_and_labels(spark, rows, step, distance):
    data, df = wide(spark, {"a": 420, "b": 333}, seed=7)
    found = windows.detection_windows(
        df, ["key"], rows, step, distance=distance, tensor=["gyro_left_z", "accel_right_z"]
    ).collect()
    expected = {k: (z.shape[1] - rows) // step + 1 for k, z in data.items()}
    assert {k: sum(r["key"] == k for r in found) for k in data} == expected
    for r in found:
        start = r["window_id"] * step
        cut = data[r["key"]][:, start : start + rows]
        assert (r["start_time"], r["end_time"]) == (start, start + rows - 1)
        assert r["gyro_left_z_max"] == cut[0].max() and r["accel_right_z_min"] == cut[3].min()
        assert np.array_equal(np.array(r["x"]), cut[[0, 3]].T)
        steps = []
        for z in cut[:2]:
            tops = [(p, z[p]) for p in maxima(z) if z[p] >= 0.3]
            steps.append(np.diff(greedy(tops, distance)))
        pairs = list(zip(*steps))
        a = [(l - q) / (l + q) for l, q in pairs]
        s = [min(p) / max(p) for p in pairs]
        if pairs:
            assert r["gyro_asymmetry_stride_times"] == pytest.approx(np.mean(a))
            assert r["gyro_symmetry_ratio_stride_times"] == pytest.approx(np.mean(s))
        else:
            assert r["gyro_asymmetry_stride_times"] is None
        for name, (high, low) in LABEL_LIMITS.items():
            label = int(abs(a[0]) > high or s[0] < low) if pairs else 2
            assert r[f"label_{name}"] == label
        # what is asymmetric under a stricter rule is so under the more lenient ones
        assert r["label_strict"] <= r["label_moderate"] <= r["label_lenient"] or r["label_strict"] == 2


def test_channel_scaling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 5, 3)) * [1, 20, 0] + [0, 5, 2]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "id int, x array<array<double>>")
    scaled = windows.normalise_channels(df, windows.channel_statistics(df)).orderBy("id").collect()
    expected = (x - x.mean(axis=(0, 1))) / (x.std(axis=(0, 1)) + 1e-7)
    assert np.allclose([r["x"] for r in scaled], expected, atol=1e-6)


def test_one_shuffle_per_row_copy(spark):
    _, df = wide(spark, {"a": 300})
    plan = windows.detection_windows(df, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sliding_windows_leave_gaps_between_wide_steps(spark):
    df = spark.range(10).select(F.lit("a").alias("key"), F.col("id").alias("n"))
    cut = windows.sliding_windows(df, rows=3, step=5)
    assert sorted((r["window_id"], r["n"]) for r in cut.collect()) == [(0, 0), (0, 1), (0, 2), (1, 5), (1, 6), (1, 7)]
