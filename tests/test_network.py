"""The network on raw windows against the same training in one process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import network

SETTINGS = network.Network(hidden=5, epochs=3, steps=4, rate=0.01)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        x = rng.normal(size=(6, 3)) * [1, 10, 0.1] + [0, 5, -2]
        rows.append((k, k % 5, x.tolist(), int(x[:3, 1].mean() > 5)))
    return spark.createDataFrame(rows, "id long, fold int, x array<array<double>>, y int").repartition(4)


def plain_training(windows, number, settings):
    rows = windows.select("id", "fold", "x", "y", F.xxhash64("id").alias("key")).orderBy("id").toPandas()
    rows = rows[rows["fold"] != number] if number is not None else rows
    x = np.stack([np.stack(v).ravel() for v in rows["x"]])
    y, key = rows["y"].to_numpy(float), rows["key"].to_numpy(np.int64)
    channels = x.reshape(-1, 3)
    model = network.Fitted(network.first_weights(18, settings), settings.hidden, channels.mean(0), channels.std(0) + network.EPSILON)
    solver = network.Adam(len(model.weights), settings.rate)
    for step in range(settings.epochs * settings.steps):
        own = key % settings.steps == step % settings.steps
        slope = network.gradient(model, x[own], y[own], network.kept_units(key[own], step, settings))
        model.weights = solver.step(model.weights, slope / own.sum())
    return model


def test_networks_of_all_folds_equal_training_in_one_process(windows):
    numbers = [0, 3, None]
    found = network.train(windows, "x", "y", ["id"], SETTINGS, "fold", numbers)
    for model, number in zip(found, numbers):
        plain = plain_training(windows, number, SETTINGS)
        assert model.mean == pytest.approx(plain.mean) and model.width == pytest.approx(plain.width)
        assert model.weights == pytest.approx(plain.weights, rel=1e-6, abs=1e-9)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    model = network.Fitted(rng.normal(size=4 * 3 + 3 + 1), 3, np.zeros(3), np.ones(3))
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    keep = network.kept_units(np.arange(7), 0, network.Network(hidden=3, dropout=0.4))
    assert set(np.round(keep, 6).ravel()) == {0.0, round(1 / 0.6, 6)}

    def loss(w):
        a, a0, b, b0 = network.Fitted(w, 3, model.mean, model.width).parts()
        p = 1 / (1 + np.exp(-((np.maximum(x @ a + a0, 0) * keep) @ b + b0)))
        return -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))

    slope = network.gradient(model, x, y, keep)
    for k in range(len(slope)):
        move = np.zeros(len(slope))
        move[k] = 1e-6
        assert slope[k] == pytest.approx((loss(model.weights + move) - loss(model.weights - move)) / 2e-6, abs=1e-5)


def test_held_out_windows_are_learned(windows):
    settings = network.Network(hidden=16, epochs=30, steps=2, rate=0.02, dropout=0.1)
    out = network.cross_predict(windows, "x", "y", ["id"], "fold", settings)
    assert out.columns == ["id", "fold", "y", "probability", "prediction"] and out.count() == 160
    assert out.filter("y = prediction").count() > 0.8 * 160
    assert out.filter("probability IS NULL OR (probability >= 0.5) <> (prediction = 1)").count() == 0


def test_without_windows_nothing_is_trained(windows):
    with pytest.raises(ValueError, match="no windows"):
        network.train(windows.limit(0), "x", "y", ["id"], SETTINGS)


def test_windows_are_written_once(windows, monkeypatch):
    paths, stage_path = [], network.stage_path
    monkeypatch.setattr(network, "stage_path", lambda spark, name: paths.append(name) or stage_path(spark, name))
    monkeypatch.setattr(network, "stage", lambda df, name="table": paths.append(name) or df, raising=False)
    out = network.cross_predict(windows, "x", "y", ["id"], "fold", network.Network(hidden=2, epochs=1, steps=2))
    assert paths == ["windows"] and out.columns == ["id", "fold", "y", "probability", "prediction"]
    assert out.count() == windows.count()
