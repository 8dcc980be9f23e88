import random

import numpy as np
import pytest
from helpers import by_key, greedy, maxima, series
from pyspark.sql import functions as F

from kinespark.operators import gait, peaks

HAND = {
    "plateau": ([0, 1, 1, 1, 0], [2]),
    "even plateau": ([0, 1, 1, 0], [1]),
    "edges": ([3, 1, 0, 1, 3], []),
    "flat": ([2, 2, 2], []),
    "flat start": ([1, 1, 0, 1, 0], [3]),
    "flat end": ([0, 1, 0, 1, 1], [1]),
    "steps up": ([0, 1, 1, 2, 2, 2, 1], [4]),
    "steps down": ([0, 2, 1, 1, 0], [1]),
    "single": ([1], []),
}


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_hand_cases(spark, size):
    df = series(spark, {k: v for k, (v, _) in HAND.items()})
    found = by_key(peaks.local_maxima(df, ["key"], size=size), "n")
    assert {k: found.get(k, []) for k in HAND} == {k: p for k, (_, p) in HAND.items()}


def noisy(seed, length, levels):
    rnd = random.Random(seed)
    return [float(rnd.randint(-levels, levels)) for _ in range(length)]


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_random_series_with_flat_tops(spark, size):
    data = {f"s{levels}": noisy(levels, 400, levels) for levels in (1, 2, 5, 100)}
    found = by_key(peaks.local_maxima(series(spark, data), ["key"], height=0.5, size=size), "n")
    for key, z in data.items():
        assert found.get(key, []) == [p for p in maxima(z) if z[p] >= 0.5]


@pytest.mark.parametrize("block,halo", [(None, None), (10, 5), (16, 8), (40, 10)])
def test_thinning_equals_the_plain_greedy_walk(spark, block, halo):
    data = {
        "noise": noisy(3, 600, 1000),
        "ties": noisy(4, 600, 2),
        "equal": [float(i % 3 == 1) for i in range(300)],
        # each candidate is higher than the one before it: decisions travel through the whole series
        "ramp": [i + (5.0 if i % 3 == 1 else 0.0) for i in range(300)],
        "fall": [-i + (5.0 if i % 3 == 1 else 0.0) for i in range(300)],
    }
    for d in (2, 5):
        candidates = peaks.local_maxima(series(spark, data), ["key"])
        found = by_key(peaks.thin_out(candidates, ["key"], d, block=block, halo=halo), "n")
        for key, z in data.items():
            assert found.get(key, []) == greedy([(p, z[p]) for p in maxima(z)], d), (key, d)


def test_a_long_chain_of_equal_peaks_takes_linear_time():
    import time

    def seconds(count):
        at = np.arange(count) * 2
        start = time.perf_counter()
        state = peaks.walk(np.ones(count), at, np.zeros(count, bool), -10, 2 * count + 10, 5)
        # from the last one on every third is kept: the others are 2 and 4 positions away from one
        assert (np.flatnonzero(state == 1) == np.arange((count - 1) % 3, count, 3)).all() and (state != 0).all()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 12 * max(seconds(100_000), 0.05)


def test_a_chain_of_equal_peaks_over_many_blocks(spark):
    count = 200_000
    df = spark.range(2 * count).selectExpr("'a' AS key", "id AS n", "CAST(id % 2 AS DOUBLE) AS z")
    found = peaks.thin_out(peaks.local_maxima(df, ["key"]), ["key"], 5).agg(
        F.count("*").alias("kept"), F.min("n").alias("first"), F.max("n").alias("last")).first()
    # maxima lie at 1, 3, ..., the last row being an edge; the last one is kept and every third before it
    top = 2 * count - 3
    assert (found["kept"], found["first"], found["last"]) == (len(range(top, 0, -6)), range(top, 0, -6)[-1], top)


def test_thinning_keeps_the_other_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 3, 5.0, "y"), ("a", 9, 1.0, None)], "key string, n long, z double, note string")
    assert sorted(tuple(r) for r in peaks.thin_out(df, ["key"], 4).collect()) == [("a", 3, 5.0, "y"), ("a", 9, 1.0, None)]


def test_distance_is_rounded_up(spark):
    z = [0, 3, 0, 2, 0, 1, 0]
    df = series(spark, {"a": z})
    assert by_key(peaks.find_peaks(df, ["key"], distance=2.0), "n") == {"a": [1, 3, 5]}
    assert by_key(peaks.find_peaks(df, ["key"], distance=2.1), "n") == {"a": [1, 5]}


def test_height_is_applied_before_distance(spark):
    df = series(spark, {"a": [0, 0.4, 0, 0.5, 0]})
    assert by_key(peaks.find_peaks(df, ["key"], height=0.5, distance=10), "n") == {"a": [3]}


def test_strides_and_kept_columns(spark):
    z = [0, 9, 0, 0, 8, 0, 0, 0, 7, 0]
    df = series(spark, {"a": z}).selectExpr("*", "n * 0.5 AS at")
    found = peaks.find_peaks(df, ["key"], distance=2, keep=["at"])
    rows = sorted(peaks.strides(found, ["key"], start=["at"], size=3).collect(), key=lambda r: r["stride_no"])
    assert [(r["stride_no"], r["start_n"], r["end_n"], r["stride_samples"]) for r in rows] == [(0, 1, 4, 3), (1, 4, 8, 4)]
    assert [(r["start_at"], r["end_at"]) for r in rows] == [(0.5, 2.0), (2.0, 4.0)]


def test_ragged_strides_pair_up_to_the_shorter_side(spark):
    rows = [("a", "left", 0, 100), ("a", "left", 1, 120), ("a", "right", 0, 110), ("z", "left", 0, 0), ("z", "right", 0, 0)]
    df = spark.createDataFrame(rows, "key string, side string, stride_no long, stride_samples long")
    out = {r["key"]: r for r in gait.stride_symmetry(df, ["key"]).collect()}
    assert out["a"]["asymmetry_index"] == pytest.approx(-10 / 210)
    assert out["a"]["symmetry_ratio"] == pytest.approx(100 / 110)
    assert (out["z"]["asymmetry_index"], out["z"]["symmetry_ratio"]) == (0.0, 0.0)


def test_swapping_sides_changes_only_the_sign(spark):
    rnd = random.Random(5)
    rows = [("a", s, i, rnd.randint(0, 90)) for s in ("left", "right") for i in range(40)]
    df = spark.createDataFrame(rows, "key string, side string, stride_no long, stride_samples long")
    swapped = df.selectExpr("key", "if(side = 'left', 'right', 'left') AS side", "stride_no", "stride_samples")
    one = {r["stride_no"]: r for r in gait.stride_symmetry(df, ["key"]).collect()}
    two = {r["stride_no"]: r for r in gait.stride_symmetry(swapped, ["key"]).collect()}
    for no, row in one.items():
        assert abs(row["asymmetry_index"]) <= 1 and 0 <= row["symmetry_ratio"] <= 1
        assert two[no]["asymmetry_index"] == pytest.approx(-row["asymmetry_index"])
        assert two[no]["symmetry_ratio"] == pytest.approx(row["symmetry_ratio"])
