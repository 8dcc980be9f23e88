import math

import numpy as np
import pytest

from kinespark.operators import forest, models


def grown(x, y, bins, depth, seed):
    """The same tree, node by node and split by split."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    weight = rng.poisson(1.0, len(x))

    def sums(rows):
        ones = sum(weight[r] for r in rows if y[r])
        return sum(weight[r] for r in rows) - ones, ones

    def squares(rows):
        a, b = sums(rows)
        return (a * a + b * b) / (a + b)

    root = {"rows": [r for r in range(len(x)) if weight[r]], "split": None}
    nodes = [root]
    for _ in range(depth):
        nodes = [n for n in nodes if min(sums(n["rows"])) > 0]
        if not nodes:
            break
        drawn = rng.random((len(nodes), width)).argsort(axis=1)[:, : math.ceil(math.sqrt(width))]
        below = []
        for node, features in zip(nodes, drawn):
            best = 1e-12
            for f in features:
                for cut in range(bins - 1):
                    parts = [[r for r in node["rows"] if (x[r, f] > cut) == side] for side in (False, True)]
                    if all(parts):
                        gain = (sum(map(squares, parts)) - squares(node["rows"])) / sum(sums(node["rows"]))
                        if gain > best + 1e-13:
                            best, node["split"] = gain, (f, gain * sum(sums(node["rows"])), [{"rows": p, "split": None} for p in parts])
            if node["split"]:
                below += node["split"][2]
        nodes = below
    worth = np.zeros(width)

    def merged(node):
        """The class of a leaf; None where splits stay."""
        if node["split"]:
            f, w, parts = node["split"]
            left, right = map(merged, parts)
            if left is None or left != right:
                worth[f] += w
                return None
            return left
        a, b = sums(node["rows"])
        return int(b > a)

    merged(root)
    return worth / worth.sum() if worth.any() else worth


@pytest.mark.parametrize("rows,bins,depth", [(60, 8, 30), (60, 8, 2), (25, 3, 30), (12, 2, 30)])
def test_tree_equals_a_plain_one(rows, bins, depth):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x, y = rng.integers(0, bins, (rows, 5)).astype(np.uint8), rng.integers(0, 2, rows)
        assert np.allclose(forest.tree_importance(x, y, bins, depth, [7, seed]), grown(x, y, bins, depth, [7, seed]))


def test_nodes_are_judged_in_parts_too(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 16, (400, 6)).astype(np.uint8), rng.integers(0, 2, 400)
    whole = forest.tree_importance(x, y, 16, 30, [1, 2])
    monkeypatch.setattr(forest, "NODES", 3)
    assert np.array_equal(forest.tree_importance(x, y, 16, 30, [1, 2]), whole)


def test_trees_without_splits_have_no_importance():
    x = np.zeros((20, 3), np.uint8)
    assert not forest.tree_importance(x, np.arange(20) % 2, 8, 30, [1]).any()
    assert not forest.tree_importance(x + np.arange(20, dtype=np.uint8)[:, None], np.ones(20, np.int64), 32, 30, [1]).any()


def test_bins_are_cut_between_values():
    assert forest.cuts(np.array([1.0, 1.0, 2.0, 4.0]), 8).tolist() == [1.5, 3.0]
    assert forest.cuts(np.ones(9), 8).tolist() == []
    values = np.random.default_rng(3).normal(size=5_000)
    counts = np.histogram(values, [-np.inf, *forest.cuts(values, 32), np.inf])[0]
    assert len(counts) == 32 and np.ptp(counts) <= 2


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4_200, 4)).round(2)
    y = (2 * x[:, 1] + x[:, 2] + rng.normal(size=len(x)) > 0).astype(int)
    return spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(y, x)], "y int, a double, b double, c double, d double").cache()


def test_importances_are_those_of_mllib(noisy):
    names = ["a", "b", "c", "d"]
    factory = models.random_forest(40, 8)
    found = {r["feature"]: r["importance"] for r in models.forest_importance(noisy, names, "y", factory).collect()}
    expected = models.fit(noisy, names, "y", factory).stages[-1].featureImportances.toArray()
    assert [found[c] for c in names] == pytest.approx(list(expected), abs=0.03)
    again = {r["feature"]: r["importance"] for r in models.forest_importance(noisy.repartition(5), names, "y", factory).collect()}
    assert again == pytest.approx(found, abs=1e-12)


def test_a_forest_is_not_a_job_per_level(spark, noisy):
    context = spark.sparkContext
    context.setJobGroup("elimination", "")
    try:
        ranks = models.recursive_elimination(noisy, ["a", "b", "c", "d"], "y", 2, factory=models.random_forest(10, 30)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["feature"] for r in ranks if r["selected_by_rfe"]} == {"b", "c"}
    assert len(context.statusTracker().getJobIdsForGroup("elimination")) < 16


def test_missing_values_and_other_classes_are_left_to_mllib(spark):
    for row in ((None, 1.0), (1, None), (1, float("nan")), (2, 1.0)):
        assert forest.held(spark.createDataFrame([(0, 1.0), row], "y int, a double"), ["a"], "y", 32) is None
