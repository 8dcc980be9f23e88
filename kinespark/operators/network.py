"""A shallow network on raw windows: flattened samples × channels, one hidden layer, trained over all folds at once.

A step reads one slice of the rows (a hash of their key, stored as a partition of the table), every task sums the
gradients of its rows, Spark adds the partial sums and the driver takes one Adam step: what is moved depends on the size of
the network, not on the rows. The networks of all folds share these passes; each is trained on the rows outside its fold,
with channels scaled by the mean and deviation of those rows alone.

Rectified hidden units with dropout, a sigmoid on top, binary cross-entropy. Dropout is drawn from the row's key and the
step, so the result does not depend on how rows lie in partitions, up to the order of floating-point sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.session import stage_path

CHUNK = 65_536  # values of a gradient that one row of partial sums holds
EPSILON = 1e-7  # added to a channel's deviation


@dataclass(frozen=True)
class Network:
    hidden: int = 64
    epochs: int = 10
    steps: int = 14  # slices of the rows, each one step of every epoch
    rate: float = 1e-3
    dropout: float = 0.3
    seed: int = 42


@dataclass
class Fitted:
    """Weights (inputs + 1 rows of hidden weights, the last one the bias; then the output weights and bias) and scaling."""

    weights: np.ndarray
    hidden: int
    mean: np.ndarray
    width: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n = len(self.weights) - self.hidden - 1
        first = self.weights[:n].reshape(-1, self.hidden)
        return first[:-1], first[-1], self.weights[n:-1], self.weights[-1]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Flat windows, the channels of a sample side by side, with every channel scaled."""
        times = x.shape[1] // len(self.mean)
        return (x - np.tile(self.mean, times)) / np.tile(self.width, times)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, a0, b, b0 = self.parts()
        return 1 / (1 + np.exp(-(np.maximum(self.scaled(x) @ a + a0, 0) @ b + b0)))


def first_weights(inputs: int, settings: Network) -> np.ndarray:
    """Uniform within the square root of 6 / (inputs + outputs) of each layer; biases 0."""
    rng = np.random.default_rng(settings.seed)
    h = settings.hidden
    one, two = math.sqrt(6 / (inputs + h)), math.sqrt(6 / (h + 1))
    return np.concatenate([rng.uniform(-one, one, inputs * h), np.zeros(h), rng.uniform(-two, two, h), [0.0]])


def kept_units(keys: np.ndarray, step: int, settings: Network) -> np.ndarray:
    """What each row's hidden units are multiplied by in a step: 0, or 1 / (1 - dropout)."""
    mixed = keys.view(np.uint64)[:, None] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)
    mixed = mixed + np.arange(1, settings.hidden + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    drawn = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (drawn >= settings.dropout) / (1 - settings.dropout)


def gradient(model: Fitted, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Sum of the rows' gradients, laid out as the weights."""
    a, a0, b, b0 = model.parts()
    z = model.scaled(x)
    before = z @ a + a0
    units = np.maximum(before, 0) * keep
    error = 1 / (1 + np.exp(-(units @ b + b0))) - y
    back = error[:, None] * b * keep * (before > 0)
    return np.concatenate([(z.T @ back).ravel(), back.sum(0), units.T @ error, [error.sum()]])


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.count = rate, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.count += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope**2
        first, second = self.first / (1 - 0.9**self.count), self.second / (1 - 0.999**self.count)
        return weights - self.rate * first / (np.sqrt(second) + 1e-7)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = pc.list_flatten(batch.column("x")).to_numpy().reshape(batch.num_rows, -1)
    return x, *(batch.column(c).to_numpy() for c in ("y", "fold", "key"))


def scalings(data: DataFrame, channels: int, numbers: Sequence[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation (+ EPSILON) of every channel over the rows outside each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, fold, _ = _columns(batch)
            for number in np.unique(fold):
                values = x[fold == number].reshape(-1, channels)
                mean = values.mean(0)
                yield pa.RecordBatch.from_pydict({
                    "fold": pa.array([number] * channels, pa.int32()), "channel": pa.array(range(channels), pa.int32()),
                    "n": pa.array([len(values)] * channels, pa.int64()), "mean": mean, "spread": ((values - mean) ** 2).sum(0),
                })

    parts = data.mapInArrow(run, "fold int, channel int, n long, mean double, spread double")
    # sums of squares about a common mean: those about each part's mean, and the parts' distances from it
    totals = parts.groupBy("fold", "channel").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        (F.sum("spread") + F.sum(F.col("n") * F.col("mean") ** 2) - F.sum(F.col("n") * F.col("mean")) ** 2 / F.sum("n")).alias("spread"),
    ).collect()  # folds × channels rows
    out = []
    for number in numbers:
        mean, width = np.zeros(channels), np.ones(channels)
        for c in range(channels):
            own = [(r["n"], r["s"], r["spread"]) for r in totals if r["channel"] == c and r["fold"] != number]
            n, s = sum(k for k, _, _ in own), sum(v for _, v, _ in own)
            if n:
                mean[c] = s / n
                width[c] = math.sqrt(max(sum(v + k * (t / k - mean[c]) ** 2 for k, t, v in own) / n, 0.0)) + EPSILON
        out.append((mean, width))
    return out


def summed(rows: DataFrame, models: list[Fitted], numbers: Sequence[int | None], step: int, settings: Network) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradients of each model over the rows outside its fold, and how many rows these are."""
    size = len(models[0].weights)
    cuts = list(range(0, size, CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(models), size)), np.zeros(len(models), np.int64)
        for batch in batches:
            x, y, fold, key = _columns(batch)
            for k, (model, number) in enumerate(zip(models, numbers)):
                own = fold != (-1 if number is None else number)
                if own.any():
                    sums[k] += gradient(model, x[own], y[own], kept_units(key[own], step, settings))
                    counts[k] += own.sum()
        for k in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([k] * len(cuts), pa.int32()), "cut": pa.array(cuts, pa.int32()),
                "rows": pa.array([counts[k]] * len(cuts), pa.int64()),
                "part": pa.array([sums[k, c : c + CHUNK].tobytes() for c in cuts], pa.binary()),
            })

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(p.as_buffer(), np.float64) for p in parts["part"]], axis=0)
        return pa.table({
            "model": pa.array([key[0].as_py()], pa.int32()), "cut": pa.array([key[1].as_py()], pa.int32()),
            "rows": pa.array([pc.sum(parts["rows"]).as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary()),
        })

    schema = "model int, cut int, rows long, part binary"
    found = rows.mapInArrow(run, schema).groupBy("model", "cut").applyInArrow(add, schema).collect()
    slopes, counts = np.zeros((len(models), size)), np.zeros(len(models), np.int64)
    for r in found:
        part = np.frombuffer(r["part"], np.float64)
        slopes[r["model"], r["cut"] : r["cut"] + len(part)], counts[r["model"]] = part, r["rows"]
    return slopes, counts


def train(data: DataFrame, x: str, label: str, key: Sequence[str], settings: Network = Network(), fold: str | None = None,
          numbers: Sequence[int | None] = (None,)) -> list[Fitted]:
    """One network per number, fitted on the rows outside that fold (None: on all). ``x`` holds samples × channels."""
    return _train(_stored(data, x, label, key, settings, fold), settings, numbers)


def _stored(data: DataFrame, x: str, label: str, key: Sequence[str], settings: Network, fold: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """The rows by slice, windows flattened; columns to keep travel in ``row``. The only copy that is written."""
    hashed = F.xxhash64(*key)
    rows = data.select(
        F.transform(F.flatten(x), lambda v: v.cast("double")).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"), hashed.alias("key"),
        F.size(x).alias("samples"), F.size(F.get(x, F.lit(0))).alias("channels"),
        F.pmod(hashed, F.lit(settings.steps)).cast("int").alias("slice"), *([F.struct(*keep).alias("row")] if keep else []),
    )
    path = stage_path(data.sparkSession, "windows")
    rows.write.partitionBy("slice").parquet(path)
    return data.sparkSession.read.schema(rows.schema).parquet(path)


def _train(stored: DataFrame, settings: Network, numbers: Sequence[int | None]) -> list[Fitted]:
    shape = stored.select("samples", "channels").first()
    if shape is None:
        raise ValueError("there are no windows to train on")
    used = ["x", "y", "fold", "key"]
    inputs = shape["samples"] * shape["channels"]
    models = [
        Fitted(first_weights(inputs, settings), settings.hidden, mean, width)
        for mean, width in scalings(stored.select(*used), shape["channels"], numbers)
    ]
    solvers = [Adam(len(m.weights), settings.rate) for m in models]
    for step in range(settings.epochs * settings.steps):
        part = stored.filter(F.col("slice") == step % settings.steps).select(*used)
        slopes, counts = summed(part, models, numbers, step, settings)
        for model, solver, slope, count in zip(models, solvers, slopes, counts):
            if count:
                model.weights = solver.step(model.weights, slope / count)
    return models


def predict(data: DataFrame, x: str, models: list[Fitted], numbers: Sequence[int | None], fold: str | None = None,
            cut: float = 0.5) -> DataFrame:
    """Add ``probability`` and ``prediction``: of the model of the row's own fold, or of the only one."""
    return _predict(data.withColumn("_x", F.transform(F.flatten(x), lambda v: v.cast("double"))).drop(x), models, numbers, fold, cut)


def _predict(flat: DataFrame, models: list[Fitted], numbers: Sequence[int | None], fold: str | None, cut: float = 0.5) -> DataFrame:
    kept = [f for f in flat.schema.fields if f.name != "_x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", probability double, prediction int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pc.list_flatten(batch.column("_x")).to_numpy().reshape(batch.num_rows, -1)
            p = np.zeros(batch.num_rows)
            own = batch.column(fold).to_numpy() if fold else np.zeros(batch.num_rows)
            for model, number in zip(models, numbers):
                mine = own == number if fold else np.ones(batch.num_rows, bool)
                if mine.any():
                    p[mine] = model.probability(values[mine])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                names=[*(f.name for f in kept), "probability", "prediction"],
            )

    return flat.mapInArrow(run, schema)


def cross_predict(data: DataFrame, x: str, label: str, key: Sequence[str], fold: str, settings: Network = Network()) -> DataFrame:
    """Every window with the class and probability of the network that has not seen its fold."""
    stored = _stored(data, x, label, key, settings, fold, list(dict.fromkeys([*key, fold, label])))
    numbers = [r[0] for r in stored.select("fold").distinct().orderBy("fold").collect()]
    return _predict(stored.select("row.*", F.col("x").alias("_x")), _train(stored, settings, numbers), numbers, fold)
