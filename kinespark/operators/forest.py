"""Feature importance in random forests on tables that one task can hold: every task grows whole trees.

MLlib reads all rows once for every level of the deepest tree and moves the dense class counts of every node; with trees of
30 levels on a few thousand rows that takes most of a minute a forest. Up to CELLS values the rows are cut into bins once
instead, travel with the tasks as bytes, and a tree is grown from its root to its leaves where it was begun. Larger tables
are left to MLlib.

The forest is MLlib's: bins cut between the values of all rows, Poisson bags, the root of the number of features drawn anew
for every node, Gini gains, leaves pure or without gain, pairs of leaves of one class merged, and importances summed as there. Bags and
features are drawn from the tree's number over rows in the order of their values, so the result depends neither on tasks nor on the
layout of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 4_000_000  # values that the driver and a task hold
NODES = 1_024  # whose class counts a task holds at once
LEAST_GAIN = 1e-12  # less is the order of floating-point sums


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between sorted values: between all distinct ones if these are few, else nearest to equal counts."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    stride, reached = len(values) / bins, counts.cumsum()
    out, target = [], stride
    for k in range(1, len(found)):
        if abs(reached[k - 1] - target) < abs(reached[k] - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out)


def held(data: DataFrame, columns: Sequence[str], label: str, bins: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins and class of every row, ordered by value; None where a value is missing or a class is not 0 or 1."""
    rows = data.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)], F.col(label).cast("double").alias("y")).toArrow()
    values = np.stack([c.to_numpy() for c in rows.columns], axis=1)
    if not np.isfinite(values).all() or not np.isin(values[:, -1], (0, 1)).all():
        return None
    values = values[np.lexsort(values.T)]
    most = min(bins, len(values))
    x = np.stack([np.searchsorted(cuts(v, most), v, "left") for v in values[:, :-1].T], axis=1)
    return x.astype(np.min_scalar_type(bins - 1)), values[:, -1].astype(np.int64)


def best_splits(x: np.ndarray, at: np.ndarray, drawn: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best split of every node.

    ``at`` holds node, class and weight of each row, ``drawn`` the features that each node may split by; of equal gains the
    first drawn and the lowest bin win.
    """
    (slot, y, weight), (nodes, tried) = at, drawn.shape
    cell = (slot[:, None] * tried + np.arange(tried)) * bins + np.take_along_axis(x, drawn[slot], axis=1)
    counts = np.bincount((cell * 2 + y[:, None]).ravel(), np.repeat(weight, tried), nodes * tried * bins * 2)
    left = counts.reshape(nodes, tried, bins, 2).cumsum(axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right = total - left
    nl, nr, n = left.sum(-1), right.sum(-1), total.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left**2).sum(-1) / nl + (right**2).sum(-1) / nr - (total**2).sum(-1) / n) / n
    gain = np.where((nl > 0) & (nr > 0), gain, -np.inf).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    every = np.arange(nodes)
    return gain[every, best], drawn[every, best // (bins - 1)], best % (bins - 1)


def tree_importance(x: np.ndarray, y: np.ndarray, bins: int, depth: int, seed: Sequence[int]) -> np.ndarray:
    """Gain times rows of the splits of one tree, by feature, as shares of their sum."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    weight = rng.poisson(1.0, len(x))
    own = np.flatnonzero(weight)
    x, y, weight = x[own], y[own], weight[own]
    slot = np.zeros(len(x), np.int64)
    # of all nodes, the root first: feature or -1, gain times rows, class, and place of the left child (the right one follows)
    feature, worth, decided, child = [np.full(1, -1)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    places, size = np.zeros(1, np.int64), 1  # of the open nodes; nodes so far
    if not 0 < y.sum() < len(y):
        places = places[:0]
    for _ in range(depth):
        if not len(places):
            break
        drawn = rng.random((len(places), width)).argsort(axis=1)[:, : math.ceil(math.sqrt(width))]
        order = np.argsort(slot, kind="stable")
        x, y, weight, slot = x[order], y[order], weight[order], slot[order]
        starts = range(0, len(places), NODES)
        ends = np.searchsorted(slot, [*starts, len(places)])
        parts = [best_splits(x[a:b], (slot[a:b] - s, y[a:b], weight[a:b]), drawn[s : s + NODES], bins) for s, a, b in zip(starts, ends, ends[1:])]
        gain, by, cut = (np.concatenate(p) for p in zip(*parts))
        rows = np.bincount(slot, weight, len(places))
        split = gain > LEAST_GAIN
        first = size + 2 * (split.cumsum() - 1)
        for level, values in ((feature, by), (worth, gain * rows), (child, first)):
            flat = np.concatenate(level)
            flat[places[split]] = values[split]
            level[:] = [flat]
        keep = split[slot]
        x, y, weight, slot = x[keep], y[keep], weight[keep], slot[keep]
        below = first[slot] - size + (x[np.arange(len(x)), by[slot]] > cut[slot])
        born = 2 * int(split.sum())
        ones, every = np.bincount(below, weight * y, born), np.bincount(below, weight, born)
        feature.append(np.full(born, -1))
        worth.append(np.zeros(born))
        child.append(np.zeros(born, np.int64))
        decided.append((2 * ones > every).astype(np.int64))
        open_ = (ones > 0) & (ones < every)
        places, size = size + np.flatnonzero(open_), size + born
        keep = open_[below]
        x, y, weight, slot = x[keep], y[keep], weight[keep], (open_.cumsum() - 1)[below[keep]]
    feature, worth, decided, child = (np.concatenate(v) for v in (feature, worth, decided, child))
    for k in np.flatnonzero(feature >= 0)[::-1]:  # children come after their parent
        a = child[k]
        if feature[a] < 0 and feature[a + 1] < 0 and decided[a] == decided[a + 1]:
            feature[k], decided[k] = -1, decided[a]
    inner = feature >= 0
    sums = np.bincount(feature[inner], worth[inner], width)
    return sums / sums.sum() if inner.any() else sums


def importance(spark: SparkSession, x: np.ndarray, y: np.ndarray, settings: RandomForestClassifier) -> np.ndarray:
    """Share of each feature in the gains of all trees."""
    trees, bins, depth, seed = settings.getNumTrees(), settings.getMaxBins(), settings.getMaxDepth(), settings.getSeed()
    width = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                shares = tree_importance(x, y, bins, depth, [seed, tree])
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([shares.tolist()])], names=["tree", "shares"])

    tasks = min(trees, spark.sparkContext.defaultParallelism)
    found = spark.range(0, trees, 1, tasks).mapInArrow(run, "tree long, shares array<double>").collect()
    sums = np.zeros(width)
    for r in sorted(found):
        sums += r["shares"]
    return sums / sums.sum() if sums.any() else sums
