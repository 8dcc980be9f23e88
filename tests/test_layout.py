import random

import pytest
from helpers import by_key, series
from pyspark.sql import functions as F

from kinespark.operators import layout
from kinespark.session import stage


def shuffled(spark, sizes):
    rows = [(k, t, t % 3, random.Random(t).random()) for k, size in sizes.items() for t in range(size)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key string, t long, tie long, v double")


def test_numbering_by_ranges_equals_numbering_by_key(spark):
    df = shuffled(spark, {"a": 501, "b": 7, "c": 1, "hot": 4000})
    plain = layout.enumerate_rows(df, ["key"], ["t", "tie"])
    ranged = layout.enumerate_rows(df, ["key"], ["t", "tie"], limit=10, ranges=6)
    for numbered in (plain, ranged):
        assert numbered.count() == 4509
        assert numbered.filter("n <> t").count() == 0


def test_only_long_series_are_split_off(spark):
    df = shuffled(spark, {"a": 501, "b": 7, "hot": 4000})
    ordinary, long = layout.split_long(df, ["key"], 501)
    assert {r["key"] for r in ordinary.select("key").distinct().collect()} == {"a", "b"}
    assert {r["key"] for r in long.select("key").distinct().collect()} == {"hot"}
    assert layout.split_long(df, ["key"], 4000)[1] is None


def test_hot_series_is_spread_over_ranges(spark):
    df = shuffled(spark, {"hot": 4000, "a": 10})
    ranged = df.repartitionByRange(6, "key", "t").withColumn("p", F.spark_partition_id())
    assert ranged.filter("key = 'hot'").select("p").distinct().count() > 1


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
def test_running_values_do_not_depend_on_the_block_size(spark, size):
    values = [None, 2, None, None, 5, 1, None, 7, None, None, None, 4]
    df = series(spark, {"a": values, "b": values[::-1]})
    out = layout.running(
        df, ["key"], totals={"count": F.col("z").isNotNull().cast("long")}, lasts={"last": F.col("z")}, size=size
    )
    for key, vs in {"a": values, "b": values[::-1]}.items():
        rows = {r["n"]: r for r in out.filter(F.col("key") == key).collect()}
        seen, last = 0, None
        for n, v in enumerate(vs):
            assert rows[n]["last"] == last
            seen += v is not None
            assert rows[n]["count"] == seen
            last = v if v is not None else last


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_neighbours_cross_block_borders(spark, size):
    df = series(spark, {"a": range(11)})
    out = layout.with_neighbours(df, ["key"], {"back": ("z", -2), "ahead": ("z", 1)}, size=size)
    rows = sorted(out.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(11))
    assert [r["back"] for r in rows] == [None, None, *range(9)]
    assert [r["ahead"] for r in rows] == [*range(1, 11), None]


def test_attach_with_and_without_broadcast(spark):
    df = shuffled(spark, {"a": 50, "b": 20})
    table = df.groupBy("key").agg(F.count("*").alias("size"))
    small = layout.attach(df, table, ["key"], "t")
    salted = layout.attach(df, table, ["key"], "t", bound=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert sorted(small.collect()) == sorted(salted.select(*small.columns).collect())


def test_by_key_helper_orders_rows(spark):
    assert by_key(series(spark, {"a": [3, 1]}), "n", "z") == {"a": [(0, 3.0), (1, 1.0)]}


def test_wide_tables_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id % 5 AS key", "id AS n")
    table = stage(spark.range(5).selectExpr("id AS key", "repeat(sha2(cast(id AS string), 512), 50) AS wide"))
    def plan():
        return layout.attach(rows, table, ["key"], stored=True)._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(layout, "BROADCAST_BYTES", 100)
    assert "strategy=broadcast" not in plan() and "_salt" in plan()
    assert layout.attach(rows, table, ["key"], stored=True).count() == 200
