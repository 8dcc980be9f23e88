"""Boosted trees against a plain NumPy version, and calibrated margins against a direct fit of the sigmoid."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kinespark.operators import boosting, models


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        a, b, c = rng.uniform(-2, 2), rng.choice([0.0, 1.0, 2.0, 5.0]), rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-(2 * a * (1 if b > 1 else -1) + 0.3 * c)))
        rows.append((i % 7, i, a, b, c, int(rng.random() < p)))
    return spark.createDataFrame(rows, "fold int, i int, a double, b double, c double, y int").repartition(5)


COLUMNS = ["a", "b", "c"]


def plain_tree(x, g, h, settings):
    """A tree grown one node at a time by trying every cut: {node: (feature, cut)}, {node: value of the rows there}."""
    splits, values = {}, {}

    def go(node, rows, level):
        gs, hs, n = g[rows].sum(), h[rows].sum(), len(rows)
        values[node] = -gs / (hs + settings.l2)
        best, choice = 1e-9, None
        if level < settings.depth and n > 1:
            for f in range(x.shape[1]):
                for cut in sorted(set(x[rows, f]))[:-1]:
                    left = rows[x[rows, f] <= cut]
                    gl, hl, nl = g[left].sum(), h[left].sum(), len(left)
                    gr, hr, nr = gs - gl, hs - hl, n - nl
                    if settings.second_order:
                        if min(hl, hr) < settings.least_hessian:
                            continue
                        gain = (gl**2 / (hl + settings.l2) + gr**2 / (hr + settings.l2) - gs**2 / (hs + settings.l2)) / 2
                    else:
                        gain = nl * nr / n * (gl / nl - gr / nr) ** 2
                    if round(gain, 9) > best:
                        best, choice = round(gain, 9), (f, int(cut))
        if choice:
            splits[node] = choice
            right = x[rows, choice[0]] > choice[1]
            go(2 * node + 1, rows[~right], level + 1)
            go(2 * node + 2, rows[right], level + 1)

    go(0, np.arange(len(x)), 0)
    return splits, values


@pytest.mark.parametrize("settings", [
    boosting.Boosting(rounds=13, depth=3, bins=16), boosting.Boosting(rounds=12, depth=2, step=0.1, l2=0.0, least_hessian=0.0, bins=16, second_order=False),
], ids=["second order", "first order"])
def test_trees_of_all_folds_equal_plain_growth(labelled, settings):
    rows = labelled.orderBy("i").toPandas()
    numbers = [0, 3, None]
    found = boosting.grow(labelled, COLUMNS, "y", settings, "fold", numbers)
    edges = found[0].edges
    x = np.stack([np.searchsorted(e, rows[c], "left") for c, e in zip(COLUMNS, edges)], axis=1)
    for model, number in zip(found, numbers):
        used = (rows["fold"] != number).to_numpy()
        xs, y = x[used], rows["y"].to_numpy()[used].astype(float)
        total = np.full(len(y), 0.0 if settings.second_order else math.log(y.mean() / (1 - y.mean())))
        assert model.start == pytest.approx(total[0])
        for tree in model.trees:
            p = boosting.sigmoid(total)
            splits, values = plain_tree(xs, p - y, p * (1 - p), settings)
            assert {k: (f, c) for k, (f, c) in enumerate(zip(tree.feature, tree.cut)) if f >= 0} == splits
            assert {k: tree.leaf[k] for k in values} == pytest.approx(values)
            total = total + settings.step * np.array(tree.leaf)[boosting.node_of(xs, tree)]


def test_held_out_predictions_scores_and_stored_model(spark, labelled, tmp_path):
    settings = boosting.Boosting(rounds=30, depth=3, bins=32)
    predicted = boosting.cross_predict(labelled, COLUMNS, "y", settings, "fold", list(range(7)))
    assert predicted.count() == 400 and predicted.select("i").distinct().count() == 400
    assert predicted.filter("y = prediction").count() > 0.7 * 400
    model = models.fit(labelled, COLUMNS, "y", settings)
    models.save(model, str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    assert again == model
    scored = models.score(again, labelled)
    assert scored.columns == [*labelled.columns, "probability", "prediction"]
    assert sorted(scored.collect()) == sorted(models.score(model, labelled).collect())
    assert scored.filter("probability IS NULL OR (probability >= 0.5) <> (prediction = 1)").count() == 0


def test_missing_values_constant_columns_and_one_class(spark):
    rows = [(float(k), None if k % 3 else float("nan"), 1.0, 1) for k in range(20)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, y int")
    for settings in (boosting.second_order(3), boosting.first_order(3)):
        model = models.fit(frame, COLUMNS, "y", settings)
        assert all(f < 0 for t in model.trees for f in t.feature) or settings.second_order
        assert models.score(model, frame).filter("probability > 0.5").count() == 20
    mixed = frame.withColumn("y", (F.col("a") > 9).cast("int"))
    assert models.score(models.fit(mixed, COLUMNS, "y", boosting.Boosting(rounds=20, depth=2)), mixed).filter("prediction = y").count() == 20


def sigmoid_fit(margins, targets):
    """Newton's method on the log-loss of sigmoid(a · margin + b)."""
    w = np.zeros(2)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), x.T @ (p - targets))
    return w


def test_margin_classifier_has_calibrated_probabilities(labelled):
    columns = ["a", "c"]
    flipped = labelled.withColumn("a", F.when(F.col("b") > 1, F.col("a")).otherwise(-F.col("a")))
    model = models.fit(flipped, columns, "y", models.linear_svm(), "fold")
    scored = models.score(model, flipped)
    assert scored.filter("probability IS NULL OR probability <= 0 OR probability >= 1").count() == 0
    margin = vector_to_array("rawPrediction")[1].alias("m")
    rows = model.transform(flipped).select(margin, vector_to_array("probability")[1].alias("p"), "prediction").orderBy("m").toPandas()
    assert (np.diff(rows["p"]) >= 0).all() and ((rows["m"] > 0) == (rows["prediction"] == 1)).all()
    # the sigmoid is that of the margins that models of the other inner folds give
    held = models.held_out_margins(flipped, columns, "y", lambda df, n: models.Pipeline(stages=[
        *models.scaling_stages(columns, n), models.linear_svm()(2, n).setLabelCol("y").setFeaturesCol("features")]).fit(df), "fold")
    found = held.toPandas()
    ones = int(found["y"].sum())
    targets = np.where(found["y"] == 1, (ones + 1) / (ones + 2), 1 / (len(found) - ones + 2))
    a, b = sigmoid_fit(found["margin"].to_numpy(), targets)
    fitted = model.stages[-1]
    assert len(found) == 400 and (fitted.coefficients[0], fitted.intercept) == pytest.approx((a, b), rel=1e-3, abs=1e-3)

    def loss(p):
        return -np.mean(np.where(found["y"] == 1, np.log(p), np.log(1 - p)))

    mine = loss(1 / (1 + np.exp(-(fitted.coefficients[0] * found["margin"] + fitted.intercept))))
    assert mine < loss(np.full(len(found), ones / len(found))) and mine == pytest.approx(loss(1 / (1 + np.exp(-(a * found["margin"] + b)))), abs=1e-4)


def test_without_both_classes_in_calibration_there_is_no_probability(spark):
    rows = [(float(k), k % 3, int(k % 3 == 0)) for k in range(30)]
    frame = spark.createDataFrame(rows, "a double, fold int, y int")
    scored = models.score(models.fit(frame, ["a"], "y", models.linear_svm(), "fold"), frame)
    assert scored.filter("prediction IS NULL").count() == 0


def test_partial_sums_added_by_driver_or_spark_agree(labelled):
    settings, columns = boosting.Boosting(rounds=1, depth=1), ["a", "b"]
    edges = boosting.bin_edges(labelled, columns, settings.bins)
    rows = labelled.select(
        F.col("y").cast("double").alias("y"), F.lit(-2).alias("fold"), boosting.binned(columns, edges).alias("bins"),
        F.array(F.lit(0.0)).alias("margins"),
    ).repartition(3)
    some = [boosting.histograms(rows, [[]], [boosting.Tree.empty(1)], 0, [None], settings, 2, tasks)
            .sort_values(["feature", "bin"]).reset_index(drop=True) for tasks in (3, boosting.DIRECT + 1)]
    assert np.allclose(some[0], some[1])
