import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinespark.operators import align, dataset


def side(spark, rows):
    return spark.createDataFrame(rows, "key string, ts string, z double")


@pytest.mark.parametrize("size", [1, 2, 100])
def test_forward_fill_after_the_outer_join(spark, size):
    left = side(spark, [("k", "a", 1.0), ("k", "b", 2.0)])
    right = side(spark, [("k", "b", 10.0), ("k", "b", 11.0), ("k", "c", 12.0)])
    merged = align.merge_sides(left, right, ["key"], columns=["z"], size=size)
    rows = sorted((r["n"], r["ts"], r["left_z"], r["right_z"]) for r in merged.collect())
    assert rows == [(0, "a", 1.0, None), (1, "b", 2.0, 10.0), (2, "b", 2.0, 11.0), (3, "c", 2.0, 12.0)]
    whole = sorted((r["n"], r["ts"]) for r in align.complete_rows(merged, ["key"]).collect())
    assert whole == [(0, "b"), (1, "b"), (2, "c")]


TIMED = "key string, ts timestamp_ntz, x double, z double"
START = dt.datetime(2024, 1, 1)


def random_sides(seed, share):
    """Two recordings with random gaps and NULLs; ``share`` of the right stamps also occur on the left."""
    rng = random.Random(seed)
    left, right = [], []
    for key, size in (("hot", 600), ("small", 40), ("left only", 5)):
        times = rng.sample(range(4 * size), size)
        left += [(key, START + dt.timedelta(milliseconds=t), None if rng.random() < 0.2 else rng.random(), float(t)) for t in times]
    for key, size in (("hot", 300), ("small", 90), ("right only", 5)):
        known = [t for k, t, *_ in left if k == key and rng.random() < share]
        fresh = [START + dt.timedelta(milliseconds=4 * t, microseconds=1) for t in rng.sample(range(4 * size), size)]
        right += [(key, t, rng.random(), None if rng.random() < 0.2 else rng.random()) for t in known + fresh]
    return left, right


def last_rows(left, right, within=None):
    """Plain Python: every stamp of a recording with the last row of each side."""
    out = []
    for key in {r[0] for r in left + right}:
        sides = [sorted(r[1:] for r in rows if r[0] == key) for rows in (left, right)]
        for n, t in enumerate(sorted({r[0] for rows in sides for r in rows})):
            found = [([r for r in rows if r[0] <= t] or [None])[-1] for rows in sides]
            found = [r if r and (within is None or t - r[0] <= within) else (None, None, None) for r in found]
            out.append((key, t, *found[0][1:], *found[1][1:], n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, share, ranges", [(1, 0.0, 7), (2, 0.5, 16), (3, 1.0, None)])
def test_asof_merge_of_ranges_equals_plain_python(spark, seed, share, ranges):
    left, right = random_sides(seed, share)
    one, two = spark.createDataFrame(left, TIMED), spark.createDataFrame(right, TIMED)
    merged = align.merge_asof(one, two, ["key"], columns=["x", "z"], ranges=ranges)
    assert merged.columns == ["key", "ts", "left_x", "left_z", "right_x", "right_z", "n"]
    assert sorted((tuple(r) for r in merged.collect()), key=repr) == last_rows(left, right)
    close = align.merge_asof(one, two, ["key"], columns=["x", "z"], ranges=ranges, tolerance=F.expr("INTERVAL 3 MILLISECONDS"))
    assert sorted((tuple(r) for r in close.collect()), key=repr) == last_rows(left, right, dt.timedelta(milliseconds=3))


def test_asof_merge_of_a_hot_recording_spans_ranges_and_equals_the_outer_join(spark):
    left, right = random_sides(4, 0.5)
    left = [(k, t, 1.0 if x is None else x, z) for k, t, x, z in left]
    right = [(k, t, x, 1.0 if z is None else z) for k, t, x, z in right]
    one, two = spark.createDataFrame(left, TIMED), spark.createDataFrame(right, TIMED)
    merged = align.merge_asof(one, two, ["key"], columns=["x", "z"], ranges=9)
    joined = align.merge_sides(one, two, ["key"], columns=["x", "z"])
    assert sorted((tuple(r) for r in merged.select(*joined.columns).collect()), key=repr) == sorted(
        (tuple(r) for r in joined.collect()), key=repr)
    of_hot = one.unionByName(two).repartitionByRange(9, "key", "ts").withColumn("range", F.spark_partition_id())
    assert of_hot.filter("key = 'hot'").select("range").distinct().count() > 2


def test_asof_merge_of_equal_stamps_missing_times_and_nothing(spark):
    left = [("k", START, 1.0, 5.0), ("k", START, 2.0, 1.0), ("k", None, 9.0, 9.0)]
    one, two = spark.createDataFrame(left, TIMED), spark.createDataFrame([], TIMED)
    assert [tuple(r) for r in align.merge_asof(one, two, ["key"], columns=["x", "z"]).collect()] == [
        ("k", START, 2.0, 1.0, None, None, 0)]
    assert align.merge_asof(two, two, ["key"], columns=["x", "z"]).count() == 0
    numbers = spark.createDataFrame([("k", 1, 0.5), ("k", 9, 0.7)], "key string, t long, z double")
    other = spark.createDataFrame([("k", 4, 1.5)], "key string, t long, z double")
    got = align.merge_asof(numbers, other, ["key"], "t", ["z"], tolerance=F.lit(4))
    assert sorted(tuple(r) for r in got.collect()) == [("k", 1, 0.5, None, 0), ("k", 4, 0.5, 1.5, 1), ("k", 9, 0.7, None, 2)]


def test_positional_pairing_is_cut_to_the_shorter_series(spark):
    one = spark.createDataFrame([("k", n, n * 1.0) for n in range(5)], "key string, n long, a double")
    two = spark.createDataFrame([("k", n, n * 2.0) for n in range(3)], "key string, n long, b double")
    assert sorted(r["n"] for r in align.zip_rows(one, two, ["key"]).collect()) == [0, 1, 2]


def test_common_interval(spark):
    rows = [("k", "left", n, 0.5 + n) for n in range(5)] + [("k", "right", n, 2.0 + n) for n in range(9)]
    df = spark.createDataFrame(rows, "key string, side string, n long, elapsed double")
    clipped = align.common_interval(df, ["key"])
    assert sorted((r["side"], r["synced"]) for r in clipped.collect()) == [
        ("left", 0.5), ("left", 1.5), ("left", 2.5), ("right", 0.0), ("right", 1.0), ("right", 2.0)]
    early = align.common_interval(df, ["key"], keep_early=True)
    assert early.agg(F.min("synced")).first()[0] == -1.5


def test_records_keep_subjects_without_features(spark):
    spine = spark.createDataFrame([("a", 0), ("b", 1)], "key string, label int")
    features = spark.createDataFrame([("a", 1.5)], "key string, f double")
    rows = dataset.subject_record(spine, [features], ["key"]).collect()
    assert sorted((r["key"], r["label"], r["f"]) for r in rows) == [("a", 0, 1.5), ("b", 1, None)]


def test_one_to_one_join_rejects_a_repeated_key(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "key string, y int")
    assert dataset.join_one_to_one(one, one.withColumnRenamed("x", "y"), ["key"]).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        dataset.join_one_to_one(one, twice, ["key"])


def test_union_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, extra double")
    rows = dataset.cohort_union([a, b]).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "x", None), (None, "y", 2.0)]
