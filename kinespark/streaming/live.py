"""Windows, alerts and scores over live samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.operators import models, windows
from kinespark.operators.layout import attach, enumerate_rows
from kinespark.session import stage, stage_path


def zoned(ts: str):
    """Watermarks need a zoned time stamp; the session zone is UTC, so the value stays the same."""
    return F.col(ts).cast("timestamp")


def sliding_extremes(stream: DataFrame, keys: Sequence[str], time: str = "ts", value: str = "z", width: str = "2 seconds",
                     slide: str = "1 second", lateness: str = "1 second") -> DataFrame:
    """Maximum and minimum per key in event-time windows; rows later than ``lateness`` are dropped."""
    timed = stream.withColumn(time, zoned(time)).withWatermark(time, lateness)
    found = timed.groupBy(F.window(time, width, slide), *keys).agg(
        F.max(value).alias("z_max"), F.min(value).alias("z_min"), F.count("*").alias("samples")
    )
    return found.select(
        *keys,
        F.col("window.start").cast("timestamp_ntz").alias("start_time"),
        F.col("window.end").cast("timestamp_ntz").alias("end_time"),
        "z_max", "z_min", "samples",
    )


def run_to_table(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Process everything available and return the table it was appended to."""
    spark = stream.sparkSession
    path = stage_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", stage_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Class and probability per streamed row, by a fitted pipeline."""
    return models.score(model, stream)


class RowWindows:
    """Row-count windows over a stream, for ``foreachBatch``.

    A micro-batch is numbered and cut by the same operators as a stored recording, so a subject
    that sends most of the rows is spread over tasks here as well. Between batches a subject keeps
    only the rows of its unfinished window (fewer than one window) and the rows newer than its
    latest time stamp minus ``lateness_s``, which wait for stragglers. A row older than what was
    already numbered cannot be placed any more and goes to the ``late`` table.

    State, windows and late rows are written under the batch id: a batch that is repeated after a
    failure starts from the previous batch's state and overwrites its own output. So are the alerts
    (windows whose stride times differ by more than ``alert_above`` percent between the sides) and, with a ``model``,
    the classes and probabilities of the windows that have all of its ``features``: both follow from the
    windows a batch has just written and can be read as soon as it ends, while the stream goes on.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, keys: Sequence[str], path: str, time: str = "ts",
                 tiebreak: Sequence[str] = (), rows: int = 200, step: int = 100, lateness_s: float = 0.0,
                 enrich: Callable[[DataFrame], DataFrame] | None = None, alert_above: float | None = None,
                 model: PipelineModel | None = None, features: Sequence[str] = (), **peaks):
        self.spark, self.keys, self.path, self.time = spark, list(keys), path, time
        self.order, self.rows, self.step, self.lateness_s = [time, *tiebreak], rows, step, lateness_s
        self.enrich, self.peaks = enrich, peaks
        self.alert_above, self.model, self.features = alert_above, model, list(features)
        self.columns = [f.name for f in schema]
        self.state_schema = T.StructType([*schema.fields, T.StructField("n", T.LongType())])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch.select(*self.columns), batch_id, self.lateness_s)

    def finish(self, batch_id: int) -> None:
        """Number the rows still waiting for stragglers; ``batch_id`` is the last batch's."""
        empty = self.spark.createDataFrame([], T.StructType(self.state_schema.fields[:-1]))
        self._advance(empty, batch_id + 1, None)

    def _written(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/*").drop("batch")

    def windows(self) -> DataFrame:
        return self._written("windows")

    def late(self) -> DataFrame:
        return self._written("late")

    def alerts(self) -> DataFrame:
        return self._written("alerts")

    def scores(self) -> DataFrame:
        return self._written("scores")

    def _emit(self, found: DataFrame, batch_id: int) -> None:
        """Write the windows of one batch, then what follows from them."""
        path = f"{self.path}/windows/batch={batch_id}"
        found.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(found.schema).parquet(path)
        if self.alert_above is not None:
            alerts = symmetry_alerts(written, self.alert_above)
            alerts.write.mode("overwrite").parquet(f"{self.path}/alerts/batch={batch_id}")
        if self.model is not None:
            scored = score_stream(written.na.drop(subset=self.features), self.model)
            scored.write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch_id}")

    def _state(self, batch_id: int) -> DataFrame:
        """What the previous batch left: numbered rows of unfinished windows, and waiting rows without ``n``."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.state_schema)
        return self.spark.read.schema(self.state_schema).parquet(f"{self.path}/state/slot={(batch_id - 1) % 2}")

    def _advance(self, batch: DataFrame, batch_id: int, lateness_s: float | None) -> None:
        state = self._state(batch_id)
        tail = state.filter("n >= 0")
        waiting = state.filter(F.col("n").isNull()).drop("n")
        # the last placed row of a subject is kept with number -1 - n, whether a window still needs it or not
        markers = state.filter("n < 0").withColumn("n", -1 - F.col("n"))
        placed = markers.groupBy(*self.keys).agg(
            F.max("n").alias("_last_n"), F.max(F.struct(*self.order)).alias("_last")
        )
        arrived = stage(batch.unionByName(waiting), "arrived")
        arrived = attach(arrived, placed, self.keys, self.time, how="left")
        late = F.coalesce(F.struct(*self.order) <= F.col("_last"), F.lit(False))
        arrived.filter(late).select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        usable = arrived.filter(~late)
        if lateness_s is None:
            released, held = usable, usable.limit(0)
        else:
            newest = usable.groupBy(*self.keys).agg(F.max(self.time).alias("_newest"))
            micros = F.lit(-round(lateness_s * 1_000_000))
            usable = attach(usable, newest, self.keys, self.time)
            due = F.col(self.time) <= F.timestamp_add("MICROSECOND", micros, F.col("_newest"))
            released, held = usable.filter(due), usable.filter(~due)
        numbered = enumerate_rows(released.select(*self.columns, "_last_n"), self.keys, self.order)
        numbered = numbered.withColumn("n", F.col("n") + F.coalesce(F.col("_last_n") + 1, F.lit(0))).drop("_last_n")
        rows = stage(tail.unionByName(numbered), "rows")

        # the tail starts where the next window starts, so finished windows cannot come up again
        found = windows.detection_windows(rows, self.keys, self.rows, self.step, time=self.time, **self.peaks)
        self._emit(self.enrich(found) if self.enrich else found, batch_id)

        ends = rows.groupBy(*self.keys).agg(F.max("n").alias("_end"))
        next_start = F.greatest(F.lit(0), F.floor((F.col("_end") + 1 - self.rows) / self.step) + 1) * self.step
        kept = attach(rows, ends, self.keys).filter(F.col("n") >= next_start).drop("_end")
        waits = held.select(*self.columns, F.lit(None).cast("long").alias("n"))
        numbered_rows = markers.unionByName(rows)
        newest_rows = numbered_rows.groupBy(*self.keys).agg(F.max("n").alias("_end"))
        latest = attach(numbered_rows, newest_rows, self.keys).filter(F.col("n") == F.col("_end")).drop("_end").distinct()
        latest = latest.withColumn("n", -1 - F.col("n"))
        kept.unionByName(waits).unionByName(latest).write.mode("overwrite").parquet(f"{self.path}/state/slot={batch_id % 2}")


def symmetry_alerts(found: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Windows whose stride times differ by more than ``threshold`` percent between the sides."""
    difference = (1 - F.col("gyro_symmetry_ratio_stride_times")) * 100
    return found.withColumn("stride_diff_pct", difference).filter(F.col("stride_diff_pct") > threshold)
