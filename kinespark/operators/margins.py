"""Linear margin classifiers of all folds, and those that calibrate them, fitted side by side.

A fit of MLlib's ``LinearSVC`` is a chain of some 300 small jobs, and with calibration every fold needs four fits. Here one
pass over the rows serves all of them: each task sums the hinge loss and its gradient for every classifier over the rows
that the classifier may see, Spark adds the partial sums, and the driver takes one step of each classifier. What is moved
depends on folds and features, not on rows.

Objective, limits and steps are those of ``LinearSVC``: mean hinge loss and an L2 penalty on the weights of the scaled
features, no penalty on the intercept, and limited-memory quasi-Newton steps (:func:`descend`), so the weights agree up to
the order of floating-point sums.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kinespark.session import stage

MEMORY = 10  # steps that a direction is drawn from
RECENT = 20  # objectives that must be level at the end
TRIALS, GROW = 19, 2.1  # step lengths that a search tries, the last of which is taken; what one too short is multiplied by
DIRECT = 8  # tasks whose partial sums the driver adds itself: a shuffle would take longer
CELLS = 2_000_000  # margins that a task holds at once

Point = tuple[float, np.ndarray]  # objective and gradient


class SearchFailed(Exception):
    """No direction, or no step along it."""


def _direction(steps: list[np.ndarray], slopes: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
    """Quasi-Newton direction from the latest steps and changes of gradient (newest first), without components that go uphill."""
    out, shares = -grad, []
    scale = 1.0
    with np.errstate(all="ignore"):
        if steps:
            curve = steps[0] @ slopes[0]
            if curve < 0 or np.isnan(curve):
                raise SearchFailed
            scale = curve / (slopes[0] @ slopes[0])
        for s, y in zip(steps, slopes):
            shares.append((s @ out) / (s @ y))
            if np.isnan(shares[-1]):
                raise SearchFailed
            out = out - shares[-1] * y
        out = out * scale
        for s, y, a in reversed([*zip(steps, slopes, shares)]):
            out = out + (a - (y @ out) / (s @ y)) * s
    return np.where(out * grad < 0, out, 0.0)


def _line(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, alpha: float, shrink: float) -> Generator:
    """The first point along a direction at which objective and slope have fallen enough, with its value and gradient.

    It starts one shrinkage below ``alpha``; a pass tries a length and both that may follow it. At a kink of the objective
    lengths may alternate until the last one is taken.
    """
    side = np.where(x != 0, np.sign(x), np.sign(-grad))
    slope, tried = direction @ grad, {}
    if slope == 0:
        return x, value, grad
    alpha *= shrink
    for _ in range(TRIALS):
        if not 1e-10 <= alpha <= 1e10:
            raise SearchFailed
        if alpha not in tried:
            lengths = [alpha, alpha * shrink, alpha * GROW]
            moved = [x + a * direction for a in lengths]
            points = [np.where(np.sign(m) == side, m, 0.0) for m in moved]  # no weight changes its sign in one step
            tried |= {a: (p, *found) for a, p, found in zip(lengths, points, (yield points))}
        at, f, g = tried[alpha]
        end = g @ direction
        if f > value + alpha * slope * 1e-4:
            alpha *= shrink
        elif end < 0.9 * slope:
            alpha *= GROW
        elif end > -0.9 * slope:
            alpha *= shrink
        else:
            break
    return at, f, g


def descend(size: int, max_iter: int, tolerance: float) -> Generator[list[np.ndarray], list[Point], np.ndarray]:
    """Yields the points whose objective and gradient it wants next, and returns the last point reached."""
    x = np.zeros(size)
    ((value, grad),) = yield [x]
    first, done, failed = value, 0, False
    recent, steps, slopes = [np.inf], [], []
    while True:
        level = len(recent) >= 2 and abs(value - max(recent)) <= tolerance * first
        if done >= max_iter or level or np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            return x
        try:
            direction = _direction(steps, slopes, grad)
            with np.errstate(all="ignore"):
                start = 1.0 if done else 0.5 / np.linalg.norm(grad)
            at, f, g = yield from _line(x, value, grad, direction, start, 0.5 if done else 0.1)
        except SearchFailed:
            if failed:
                return x
            failed, steps, slopes = True, [], []
            continue
        steps, slopes = [at - x, *steps][:MEMORY], [g - grad, *slopes][:MEMORY]
        x, value, grad, done, failed = at, f, g, done + 1, False
        recent = [*recent, value][-RECENT:]


@dataclass
class Margin:
    """A classifier on the rows of some folds: their count, scaling and penalty, and weights and intercept of the raw columns."""

    own: np.ndarray  # whether each fold's rows are used
    rows: int
    mean: np.ndarray
    inverse: np.ndarray  # of the sample deviation, 0 for a constant column
    penalty: np.ndarray
    weights: np.ndarray | None = None

    def plain(self, point: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Weights and intercept for columns less ``shift``."""
        w = point[:-1] * self.inverse
        return np.append(w, point[-1] - w @ (self.mean - shift))

    def judged(self, point: np.ndarray, sums: np.ndarray, shift: np.ndarray) -> Point:
        """Objective and gradient from the sums of the rows' losses, pulls and pulled columns (less ``shift``)."""
        loss, pull, pulled = sums[0] / self.rows, sums[1] / self.rows, sums[2:] / self.rows
        w = point[:-1]
        slope = (pulled - (self.mean - shift) * pull) * self.inverse + self.penalty * w
        return loss + 0.5 * float((self.penalty * w) @ w), np.append(slope, pull)


def _cells(rows: DataFrame, width: int) -> tuple[list, dict[tuple[int, int], int], dict]:
    """Folds in order; rows per (fold's place, class); and per fold its count, means, squares about them, minima and maxima."""
    x = [F.get("x", F.lit(j)) for j in range(width)]
    found = rows.groupBy("fold", "y").agg(
        F.count("*").alias("n"), *[
            F.array(*[f(c) for c in x]).alias(name)
            for name, f in (("mean", F.avg), ("square", F.var_pop), ("low", F.min), ("high", F.max))
        ]
    ).collect()  # folds × classes
    folds = sorted({r["fold"] for r in found})
    place = {f: k for k, f in enumerate(folds)}
    if any(r["y"] not in (0, 1) for r in found):
        raise ValueError("a margin classifier needs the classes 0 and 1")
    parts = [(place[r["fold"]], r["n"], *(np.array(r[c]) for c in ("mean", "square", "low", "high"))) for r in found]
    return folds, {(place[r["fold"]], int(r["y"])): r["n"] for r in found}, parts


def _scaled(parts: list, own: np.ndarray, estimator: Callable[[int, int], LinearSVC]) -> Margin:
    """The classifier on the rows of some folds, not yet fitted."""
    used = [p for p in parts if own[p[0]]]
    n = np.array([p[1] for p in used], float)
    total = int(n.sum())
    strength = estimator(len(parts[0][2]), total).getRegParam()  # fails without rows
    mean, square, low, high = (np.array([p[k] for p in used]) for k in (2, 3, 4, 5))
    away = mean - mean[0]
    middle = (n @ away) / total
    spread = n @ (square + (away - middle) ** 2)
    varied = low.min(0) < high.max(0)
    inverse = np.where(varied, np.sqrt((total - 1) / np.where(varied, spread, 1.0)), 0.0)
    # the features have population deviation 1, so their sample deviation is the root of n / (n - 1)
    return Margin(own, total, mean[0] + middle, inverse, np.where(varied, strength * (total - 1) / total, 0.0))


def _arrays(batch: pa.RecordBatch, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, class and place of the fold of each row."""
    x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y = batch.column("y").to_numpy(zero_copy_only=False)
    return x, y, np.searchsorted(folds, batch.column("fold").to_numpy(zero_copy_only=False))


def summed(rows: DataFrame, folds: np.ndarray, own: np.ndarray, weights: np.ndarray, shift: np.ndarray, partitions: int) -> np.ndarray:
    """Per row of ``weights``: loss, pull on the margin, and the pulled columns, summed over the rows of its own folds."""
    count, width = len(weights), weights.shape[1] - 1
    names = [f"s{j}" for j in range(width + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, width + 2))
        for batch in batches:
            all_x, all_y, all_places = _arrays(batch, folds)
            size = max(1, CELLS // count)
            for at in range(0, len(all_x), size):
                x, y, places = all_x[at : at + size] - shift, 2 * all_y[at : at + size] - 1, all_places[at : at + size]
                slack = 1 - y[:, None] * (x @ weights[:, :-1].T + weights[:, -1])
                short = (slack > 0) & own[:, places].T
                pull = np.where(short, -y[:, None], 0.0)
                sums[:, 0] += np.where(short, slack, 0.0).sum(0)
                sums[:, 1] += pull.sum(0)
                sums[:, 2:] += pull.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), *(pa.array(s) for s in sums.T)], names=["model", *names])

    parts = rows.mapInArrow(run, "model int, " + ", ".join(f"{c} double" for c in names))
    if partitions > DIRECT:
        parts = parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((count, width + 2))
    for r in parts.collect():
        out[r["model"]] += r[1:]
    return out


def train(rows: DataFrame, folds: np.ndarray, models: list[Margin], max_iter: int, tolerance: float) -> None:
    """Fit all the classifiers: each pass judges the points that the unfinished ones want next."""
    shift, partitions = models[0].mean, rows.rdd.getNumPartitions()
    solvers = [descend(len(shift) + 1, max_iter, tolerance) for _ in models]
    wanted = {k: next(s) for k, s in enumerate(solvers)}
    while wanted:
        asked = [(k, p) for k, points in wanted.items() for p in points]
        own = np.array([models[k].own for k, _ in asked])
        sums = summed(rows, folds, own, np.array([models[k].plain(p, shift) for k, p in asked]), shift, partitions)
        judged: dict[int, list[Point]] = {}
        for (k, p), s in zip(asked, sums):
            judged.setdefault(k, []).append(models[k].judged(p, s, shift))
        for k, answer in judged.items():
            try:
                wanted[k] = solvers[k].send(answer)
            except StopIteration as end:
                models[k].weights = models[k].plain(end.value, np.zeros_like(shift))
                del wanted[k]


def cross_predict(data: DataFrame, columns: Sequence[str], label: str, estimator: Callable[[int, int], LinearSVC], fold: str,
                  inner: int, calibrate: Callable[[DataFrame, str], LogisticRegressionModel], parallel: int = 16) -> DataFrame:
    """Every row with the class, and the probability, of the classifier that has not seen its fold.

    The probability is the sigmoid that ``calibrate`` fits to margins of the other folds' rows, each from a classifier that
    has not seen the row's fold and those with the same number modulo ``inner`` either; NULL where these have a single class.
    """
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="error").transform(data)
    rows = assembled.filter(F.col(fold).isNotNull()).select(
        F.col(fold).cast("long").alias("fold"), F.col(label).cast("double").alias("y"), vector_to_array("_raw").alias("x")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    settings = estimator(len(columns), 2)
    found, classes, parts = _cells(rows, len(columns))
    folds = np.array(found, np.int64)
    groups = np.mod(folds, inner)
    models: list[Margin] = []
    known: dict[bytes, int] = {}

    def model_of(own: np.ndarray) -> int:
        """Classifiers on the same folds are one."""
        if own.tobytes() not in known:
            known[own.tobytes()] = len(models)
            models.append(_scaled(parts, own, estimator))
        return known[own.tobytes()]

    def labels(own: np.ndarray) -> set[int]:
        return {y for k, y in classes if own[k]}

    main, held = [], {}
    for k in range(len(folds)):
        own = np.arange(len(folds)) != k
        main.append(model_of(own))
        if 1 not in labels(own):
            raise ValueError("a margin classifier needs rows of both classes")
        inside = {g: own & (groups != g) for g in sorted({*groups[own]}) if len(labels(own & (groups != g))) == 2}
        if len(set().union(*(labels(own & (groups == g)) for g in inside))) == 2:
            held[k] = {g: model_of(o) for g, o in inside.items()}
    train(rows, folds, models, settings.getMaxIter(), settings.getTol())
    weights = np.array([m.weights for m in models])
    sigmoids = _sigmoids(rows, folds, groups, weights, held, label, calibrate, parallel)
    rows.unpersist()
    return _predicted(assembled.filter(F.col(fold).isNotNull()), data, fold, folds, weights[main], sigmoids)


def _sigmoids(rows: DataFrame, folds: np.ndarray, groups: np.ndarray, weights: np.ndarray, held: dict[int, dict[int, int]], label: str,
              calibrate: Callable[[DataFrame, str], LogisticRegressionModel], parallel: int) -> np.ndarray:
    """Slope and intercept of each fold's sigmoid, NaN where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, places = _arrays(batch, folds)
            for k, inside in held.items():
                for g, m in inside.items():
                    own = (places != k) & (groups[places] == g)
                    margin = x[own] @ weights[m, :-1] + weights[m, -1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(margin), pa.int32()), pa.array(y[own].astype(np.int32)), pa.array(margin)],
                        names=["place", "y", "margin"],
                    )

    out = np.full((len(folds), 2), np.nan)
    if not held:
        return out
    margins = stage(rows.mapInArrow(run, "place int, y int, margin double").withColumnRenamed("y", label), "margins")

    def one(k: int) -> None:
        model = calibrate(margins.filter(F.col("place") == k).drop("place"), label)
        out[k] = model.coefficients[0], model.intercept

    with ThreadPool(parallel) as pool:
        pool.map(one, list(held), chunksize=1)
    return out


def _predicted(assembled: DataFrame, data: DataFrame, fold: str, folds: np.ndarray, weights: np.ndarray, sigmoids: np.ndarray) -> DataFrame:
    kept = data.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", probability double, prediction int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pc.list_flatten(batch.column("_x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            places = np.searchsorted(folds, batch.column(fold).to_numpy(zero_copy_only=False))
            margin = (x * weights[places, :-1]).sum(1) + weights[places, -1]
            slope, start = sigmoids[places].T
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(slope * margin + start)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(p, from_pandas=True), pa.array((margin > 0).astype(np.int32))],
                names=[*(f.name for f in kept), "probability", "prediction"],
            )

    return assembled.select(*data.columns, vector_to_array("_raw").alias("_x")).mapInArrow(run, schema)
