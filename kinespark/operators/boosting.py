"""Gradient-boosted trees grown from histograms: one aggregation per level for all folds at once.

Features are cut into at most ``bins`` bins and stored once. A level of a tree needs, per node, feature and bin, the
sums of the loss's first and second derivatives: each task sums its rows in dense arrays, Spark adds the partial sums,
and the driver picks the splits from a table whose size depends on the settings only. The models of all folds grow
side by side in the same passes, each on the rows outside its fold, so cross-validation costs as many jobs as a
single fit.

Two kinds, both for log-loss: ``second_order`` splits by gradient and Hessian with an L2 penalty on the leaves;
the other kind splits by the variance of the gradients and starts from the class share.

Margins are stored anew every REFRESH rounds; in between tasks add the few newer trees. A NULL or NaN feature falls
into the lowest bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.session import stage

REFRESH = 10
TASK_ROWS = 50_000  # rows of a small table that one task takes
DIRECT = 8  # tasks whose partial sums the driver adds itself: a shuffle would take longer
ACCURACY = 10_000  # of the quantiles that the bins are cut at


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    l2: float = 1.0
    least_hessian: float = 1.0  # of either side of a split
    bins: int = 64
    second_order: bool = True


def second_order(rounds: int = 100) -> Boosting:
    return Boosting(rounds)


def first_order(rounds: int = 100) -> Boosting:
    return Boosting(rounds, depth=3, step=0.1, l2=0.0, least_hessian=0.0, second_order=False)


@dataclass
class Tree:
    """A full binary tree in heap order: node k has the children 2k + 1 (bin <= cut) and 2k + 2."""

    feature: list[int]
    cut: list[int]
    leaf: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls([-1] * size, [0] * size, [0.0] * size)


def node_of(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The node at which each row's way through the tree ends."""
    feature, cut = np.array(tree.feature), np.array(tree.cut)
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(int(math.log2(len(feature) + 1)) - 1):
        at = feature[node]
        right = bins[rows, np.maximum(at, 0)] > cut[node]
        node = np.where(at >= 0, 2 * node + 1 + right, node)
    return node


def margins(bins: np.ndarray, trees: Sequence[Tree], step: float) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += step * np.array(tree.leaf)[node_of(bins, tree)]
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Values after which a new bin starts: distinct quantiles of each column, the largest value left out."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, ACCURACY).alias(f"q{k}")
                     for k, c in enumerate(columns)], *[F.max(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [sorted({v for v in found[f"q{k}"] or [] if v < found[f"m{k}"]}) for k in range(len(columns))]


def binned(columns: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """The bin of each column: how many edges lie below its value."""
    def one(name: str, cuts: Sequence[float]) -> Column:
        if not cuts:
            return F.lit(0).cast("short")
        value = F.col(name).cast("double")
        below = F.size(F.filter(F.lit(list(cuts)), lambda e: e < value))
        return F.when(value.isNull() | F.isnan(value), 0).otherwise(below).cast("short")

    return F.array(*[one(c, cuts) for c, cuts in zip(columns, edges)])


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy().reshape(-1, width)


HISTOGRAM = "model int, node int, feature int, bin int, g double, h double, n long"


def histograms(data: DataFrame, grown: list[list[Tree]], growing: list[Tree], level: int, folds: Sequence[int | None],
               settings: Boosting, width: int, tasks: int = DIRECT + 1) -> pd.DataFrame:
    """Sums of gradient, Hessian and rows per model, node of this level, feature and bin.

    A row of partial sums per task, so the driver adds those of up to DIRECT ``tasks``; of more, Spark does.
    """
    first, nodes, bins = 2**level - 1, 2**level, settings.bins
    folds = [-1 if f is None else f for f in folds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(folds), 3, width, nodes * bins))
        for batch in batches:
            x, base = _matrix(batch, "bins", width), _matrix(batch, "margins", len(folds))
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for m, own in enumerate(folds):
                node = node_of(x, growing[m]) - first
                used = np.flatnonzero((fold != own) & (node >= 0))
                if not len(used):
                    continue
                xs, at = x[used], node[used] * bins
                p = sigmoid(base[used, m] + margins(xs, grown[m], settings.step))
                for f in range(width):
                    slot = at + xs[:, f]
                    for k, weight in enumerate((p - y[used], p * (1 - p), None)):
                        sums[m, k, f] += np.bincount(slot, weight, nodes * bins)
        m, f, slot = np.nonzero(sums[:, 2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in (
                (m, pa.int32()), (slot // bins + first, pa.int32()), (f, pa.int32()), (slot % bins, pa.int32()),
                (sums[m, 0, f, slot], pa.float64()), (sums[m, 1, f, slot], pa.float64()), (sums[m, 2, f, slot], pa.int64()),
            )], names=["model", "node", "feature", "bin", "g", "h", "n"],
        )

    keys = ["model", "node", "feature", "bin"]
    parts = data.select("bins", "margins", "y", "fold").mapInArrow(run, HISTOGRAM)
    if tasks <= DIRECT:
        return parts.toPandas().groupby(keys, as_index=False).sum()
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toPandas()


def split(table: pd.DataFrame | dict[str, np.ndarray], settings: Boosting) -> tuple[float, tuple[int, int] | None, list[float]]:
    """The value of one node as a leaf, its best (feature, cut) or None, and the values of the two children.

    Of equal gains the first feature and the lowest cut win.
    """
    def value(g: float, h: float) -> float:
        return float(-g / (h + settings.l2)) if h + settings.l2 > 1e-12 else 0.0

    order = np.lexsort((table["bin"], table["feature"]))
    features, bins, gs, hs, ns = (np.asarray(table[c])[order] for c in ("feature", "bin", "g", "h", "n"))
    starts = np.flatnonzero(np.diff(features, prepend=-1))
    parts = [slice(i, j) for i, j in zip(starts, [*starts[1:], len(features)])]
    g, h, n = (v[parts[0]].sum() for v in (gs, hs, ns))
    best, choice, children = 1e-9, None, []
    for part in parts if n > 1 else ():
        gl, hl, nl = (v[part].cumsum()[:-1] for v in (gs, hs, ns))
        gr, hr, nr = g - gl, h - hl, n - nl
        if settings.second_order:
            gain = (gl**2 / (hl + settings.l2) + gr**2 / (hr + settings.l2) - g**2 / (h + settings.l2)) / 2
            gain = np.where((hl >= settings.least_hessian) & (hr >= settings.least_hessian), gain, -np.inf)
        else:
            gain = nl * nr / n * (gl / nl - gr / nr) ** 2
        if len(gain):
            k = int(np.argmax(np.round(gain, 9)))
            if round(gain[k], 9) > best:
                best, choice = round(gain[k], 9), (int(features[part][k]), int(bins[part][k]))
                children = [value(gl[k], hl[k]), value(gr[k], hr[k])]
    return value(g, h), choice, children


@dataclass
class Boosted:
    """A fitted model; ``trees`` cut at bins, ``edges`` turn values into bins."""

    settings: Boosting
    columns: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self) -> Column:
        edges, trees, step, start = [np.array(e) for e in self.edges], self.trees, self.settings.step, self.start

        @F.pandas_udf("double")
        def total(values: pd.DataFrame) -> pd.Series:
            x = np.stack([np.searchsorted(e, values[c].to_numpy(float), "left") for c, e in zip(values, edges)], axis=1)
            x[np.isnan(values.to_numpy(float))] = 0
            return pd.Series(start + margins(x, trees, step))

        return total(F.struct(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(self.columns)]))

    def score(self, df: DataFrame, cut: float = 0.5) -> DataFrame:
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return df.withColumn("_margin", self.margin()).withColumn("probability", p).withColumn(
            "prediction", (F.col("probability") >= cut).cast("int")
        ).drop("_margin")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    found["settings"], found["trees"] = Boosting(**found["settings"]), [Tree(**t) for t in found["trees"]]
    return Boosted(**found)


def grow(data: DataFrame, columns: Sequence[str], label: str, settings: Boosting, fold: str | None = None,
         numbers: Sequence[int | None] = (None,), edges: list[list[float]] | None = None) -> list[Boosted]:
    """One model per number, fitted on the rows outside that fold (None: on all rows)."""
    columns = list(columns)
    edges = edges or bin_edges(data, columns, settings.bins)
    if any(len(e) >= settings.bins for e in edges):
        raise ValueError("more edges than bins")
    marked = data.select(F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"),
                         binned(columns, edges).alias("bins"))
    if settings.second_order:
        starts = [0.0] * len(numbers)
    else:
        sizes = marked.groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("ones")).collect()
        starts = []
        for number in numbers:
            n, ones = (sum(r[c] for r in sizes if r["fold"] != number) for c in ("n", "ones"))
            starts.append(math.log(ones / (n - ones)) if 0 < ones < n else math.copysign(20.0, ones - 0.5))
    # every level is a job over all partitions, so a small table must not have many
    stored = stage(marked.withColumn("margins", F.lit(starts)), "binned")
    tasks = max(1, -(-stored.count() // TASK_ROWS))
    stored = stage(stored.coalesce(tasks), "binned")
    found = [Boosted(settings, columns, edges, start) for start in starts]
    fresh: list[list[Tree]] = [[] for _ in found]
    for round_no in range(settings.rounds):
        growing = [Tree.empty(settings.depth) for _ in found]
        for level in range(settings.depth):
            sums = histograms(stored, fresh, growing, level, numbers, settings, len(columns), tasks)
            values = {c: sums[c].to_numpy() for c in ("feature", "bin", "g", "h", "n")}
            for (m, node), at in sums.groupby(["model", "node"]).indices.items():
                tree = growing[m]
                tree.leaf[node], choice, children = split({c: v[at] for c, v in values.items()}, settings)
                if choice:
                    tree.feature[node], tree.cut[node] = choice
                    tree.leaf[2 * node + 1], tree.leaf[2 * node + 2] = children
            if all(t.feature[k] < 0 for t in growing for k in range(2**level - 1, 2 ** (level + 1) - 1)):
                break
        for model, new, tree in zip(found, fresh, growing):
            model.trees.append(tree)
            new.append(tree)
        if (round_no + 1) % REFRESH == 0 and round_no + 1 < settings.rounds:
            stored, fresh = _refreshed(stored, fresh, settings, len(columns)), [[] for _ in found]
    return found


def _refreshed(data: DataFrame, fresh: list[list[Tree]], settings: Boosting, width: int) -> DataFrame:
    """The stored rows with the newer trees added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "bins", width)
            base = _matrix(batch, "margins", len(fresh)) + np.stack([margins(x, t, settings.step) for t in fresh], axis=1)
            listed = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(fresh), base.ravel())
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", listed)

    return stage(data.mapInArrow(run, data.schema), "binned")


def cross_predict(data: DataFrame, columns: Sequence[str], label: str, settings: Boosting, fold: str, numbers: Sequence[int]) -> DataFrame:
    """Every row with the prediction of the model that has not seen its fold."""
    models = grow(data, columns, label, settings, fold, numbers)
    parts = [model.score(data.filter(F.col(fold) == number)) for number, model in zip(numbers, models)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
