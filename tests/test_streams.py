import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinespark.operators import layout, models, windows
from kinespark.session import stage_path
from kinespark.streaming import live

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, seq long, gyro_left_z double, gyro_right_z double, accel_left_z double, accel_right_z double"


def rows(sizes, seed=0):
    rnd = random.Random(seed)
    out = [
        (k, START + dt.timedelta(milliseconds=10 * i), i, *[float(rnd.randint(-5, 9)) for _ in range(4)])
        for k, size in sizes.items() for i in range(size)
    ]
    return sorted(out, key=lambda r: r[1])


def feed(spark, batches):
    """A folder with one file per batch and a stream that reads them one at a time."""
    path = stage_path(spark, "feed")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, batches, lateness_s):
    sink = live.RowWindows(
        spark, spark.createDataFrame([], SCHEMA).schema, ["key"], stage_path(spark, "rows"), tiebreak=["seq"],
        lateness_s=lateness_s, rows=40, step=20, distance=8,
    )
    query = (
        feed(spark, batches).writeStream.foreachBatch(sink)
        .option("checkpointLocation", stage_path(spark, "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    sink.finish(query.lastProgress["batchId"])
    return sink


def stored(spark, data):
    df = layout.enumerate_rows(spark.createDataFrame(data, SCHEMA), ["key"], ["ts", "seq"])
    return windows.detection_windows(df, ["key"], 40, 20, distance=8)


def test_stream_equals_batch_with_late_rows_in_time(spark):
    data = rows({"a": 230, "b": 75, "c": 39})
    cuts = [data[:150], data[150:160], data[160:]]
    # swap rows over the borders of the batches by less than the permitted lateness
    cuts[0][-1], cuts[1][3] = cuts[1][3], cuts[0][-1]
    cuts[1][-1], cuts[2][2] = cuts[2][2], cuts[1][-1]
    sink = run(spark, cuts, lateness_s=1.0)
    found, expected = sink.windows(), stored(spark, data)
    assert expected.count() == 10 + 2
    assert sorted(found.select(*expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)
    assert sink.late().count() == 0
    alerts = live.symmetry_alerts(found, 10.0)
    assert alerts.count() == expected.filter("gyro_symmetry_ratio_stride_times < 0.9").count() > 0


@pytest.mark.parametrize("size, step", [(40, 20), (40, 40), (40, 60)])
def test_batches_of_any_step_with_equal_time_stamps_over_their_borders(spark, size, step):
    data = [(k, START + dt.timedelta(milliseconds=10 * (i // 2)), i, *v) for k, _, i, *v in rows({"a": 230, "b": 75})]
    data.sort(key=lambda r: (r[1], r[2]))
    sink = live.RowWindows(
        spark, spark.createDataFrame([], SCHEMA).schema, ["key"], stage_path(spark, "rows"), tiebreak=["seq"],
        rows=size, step=step, distance=8,
    )
    for batch, cut in enumerate([data[:81], data[81:83], data[83:163], data[163:]]):
        sink(spark.createDataFrame(cut, SCHEMA), batch)
    sink.finish(3)
    whole = layout.enumerate_rows(spark.createDataFrame(data, SCHEMA), ["key"], ["ts", "seq"])
    expected = windows.detection_windows(whole, ["key"], size, step, distance=8)
    assert sorted(sink.windows().select(*expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)
    assert sink.late().count() == 0


def test_rows_that_come_too_late_are_set_apart(spark):
    data = rows({"a": 120})
    late = data.pop(10)
    sink = run(spark, [data[:60], data[60:] + [late]], lateness_s=0.0)
    assert [r["seq"] for r in sink.late().collect()] == [10]
    expected = stored(spark, data)
    assert sorted(sink.windows().select(*expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)


def test_a_repeated_batch_overwrites_its_own_output(spark):
    data = rows({"a": 100})
    schema = spark.createDataFrame([], SCHEMA).schema
    sink = live.RowWindows(spark, schema, ["key"], stage_path(spark, "rows"), tiebreak=["seq"], rows=40, step=20, distance=8)
    first, second = (spark.createDataFrame(part, SCHEMA) for part in (data[:50], data[50:]))
    for number, batch in ((0, first), (1, second), (1, second)):
        sink(batch, number)
    expected = stored(spark, data)
    assert sorted(sink.windows().select(*expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)


def test_alerts_and_scores_come_out_with_their_batch_and_once(spark):
    data = rows({"a": 230, "b": 75})
    everything = stored(spark, data)
    usable = everything.na.drop()
    features = windows.ASYMMETRY_FEATURES
    model = models.fit(usable.withColumn("label", (F.col(features[1]) < 0.9).cast("int")), features, "label", models.logistic_regression(50))
    sink = live.RowWindows(
        spark, spark.createDataFrame([], SCHEMA).schema, ["key"], stage_path(spark, "rows"), tiebreak=["seq"], rows=40, step=20,
        distance=8, alert_above=10.0, model=model, features=features,
    )
    seen = {}

    def handle(batch, number):
        for _ in range(2 if number == 1 else 1):  # the second batch is repeated, as after a failure
            sink(batch, number)
        # the stream is still running here
        seen[number] = (sink.windows().count(), sink.alerts().count(), sink.scores().count())

    query = (
        feed(spark, [data[:100], data[100:200], data[200:]]).writeStream.foreachBatch(handle)
        .option("checkpointLocation", stage_path(spark, "ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(seen) == [0, 1, 2] and 0 < seen[0][1] < seen[2][1] and seen[0][2] < seen[2][2]
    sink.finish(2)
    expected = live.symmetry_alerts(everything, 10.0)
    assert sorted(sink.alerts().select(*expected.columns).collect(), key=str) == sorted(expected.collect(), key=str)
    scored = models.score(model, usable)
    assert sorted(sink.scores().select(*scored.columns).collect(), key=str) == sorted(scored.collect(), key=str)


def test_watermark_drops_rows_of_closed_windows(spark):
    schema = "key string, ts timestamp_ntz, z double"
    path = stage_path(spark, "feed")
    times = [[0, 1, 2, 3], [30, 31], [61], [1, 62], [120]]
    for batch in times:
        data = [("a", START + dt.timedelta(seconds=s), float(s)) for s in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = live.run_to_table(live.sliding_extremes(stream, ["key"], lateness="5 seconds"))
    by_start = {(r["start_time"] - START).total_seconds(): (r["samples"], r["z_max"]) for r in found.collect()}
    # the second row at 1 s came after the watermark had closed its windows
    assert by_start[0.0] == (2, 1.0) and by_start[1.0] == (2, 2.0)
    assert by_start[61.0] == (2, 62.0)
    assert 120.0 not in by_start


def test_scores_in_a_stream_equal_scores_in_batch(spark):
    train = spark.createDataFrame([(float(i), float(-i), int(i > 5)) for i in range(12)], "z_max double, z_min double, label int")
    model = models.fit(train, ["z_max", "z_min"], "label", models.logistic_regression(50))
    path = stage_path(spark, "feed")
    train.write.parquet(path)
    streamed = live.run_to_table(live.score_stream(spark.readStream.schema(train.schema).parquet(path), model))
    assert sorted(streamed.collect()) == sorted(models.score(model, train).collect())
