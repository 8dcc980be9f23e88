"""Margin classifiers that all folds share passes for, against MLlib's fits one by one."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from kinespark.operators import folds, margins, models

COLUMNS = ["a", "b", "constant", "d"]


def table(spark, seed, rows, groups, noise):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 3)) * [1, 40, 0.01] + [0, 400, -5]
    y = (x[:, 0] + (x[:, 1] - 400) / 40 + noise * rng.normal(size=rows) > 0).astype(int)
    data = [(i % groups, i, int(c), float(r[0]), float(r[1]), 7.1, float(r[2])) for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "fold int, i int, y int, a double, b double, constant double, d double").repartition(3).cache()


def one_by_one(data, factory):
    """What :func:`models.fit` says about every fold, by row."""
    out = {}
    for k in sorted(r[0] for r in data.select("fold").distinct().collect()):
        model = models.fit(data.filter(F.col("fold") != k), COLUMNS, "y", factory, "fold")
        out |= {r["i"]: (r["prediction"], r["probability"]) for r in models.score(model, data.filter(F.col("fold") == k)).collect()}
    return out


@pytest.mark.parametrize("seed,rows,groups,noise,iterations", [(1, 90, 3, 1.0, 12)])
def test_folds_together_equal_fits_one_by_one(spark, seed, rows, groups, noise, iterations):
    data = table(spark, seed, rows, groups, noise)
    factory = models.linear_svm(iterations)
    expected = one_by_one(data, factory)
    found = margins.cross_predict(data, COLUMNS, "y", factory, "fold", models.INNER_FOLDS, models.calibrator).collect()
    assert len(found) == rows
    for r in found:
        prediction, probability = expected[r["i"]]
        assert r["prediction"] == prediction
        assert r["probability"] == pytest.approx(probability, abs=1e-6)


def test_sums_are_alike_over_few_and_many_tasks(spark):
    data = table(spark, 4, 60, 4, 1.0)
    rows = data.select(F.col("fold").cast("long").alias("fold"), F.col("y").cast("double").alias("y"), F.array(*COLUMNS).alias("x"))
    numbers, weights = np.arange(4), np.array([[1.0, 0.1, 0.0, 2.0, -1.0], [0.0, 0.0, 0.0, 0.0, 0.5]])
    own = np.array([[False, True, True, True], [True, True, False, False]])
    shift = np.array([0.0, 400.0, 7.0, -5.0])
    few = margins.summed(rows, numbers, own, weights, shift, 1)
    many = margins.summed(rows.repartition(12), numbers, own, weights, shift, 12)
    assert np.allclose(few, many)
    plain = data.toPandas()
    for k in range(2):
        used = plain[own[k][plain["fold"]]]
        x, y = used[COLUMNS].to_numpy() - shift, 2 * used["y"].to_numpy() - 1
        slack = 1 - y * (x @ weights[k, :-1] + weights[k, -1])
        pull = np.where(slack > 0, -y, 0)
        assert np.allclose(few[k], [slack[slack > 0].sum(), pull.sum(), *(pull @ x)])


def test_steps_are_those_of_a_single_fit(spark):
    data = table(spark, 2, 90, 5, 0.0).coalesce(1)
    rows = data.select(F.lit(0).cast("long").alias("fold"), F.col("y").cast("double").alias("y"), F.array(*COLUMNS).alias("x"))
    _, _, parts = margins._cells(rows, 4)
    model = margins._scaled(parts, np.array([True]), models.linear_svm())
    margins.train(rows.cache(), np.array([0]), [model], 100, 1e-3)
    fitted = Pipeline(stages=[
        *models.scaling_stages(COLUMNS, 90), models.linear_svm()(4, 90).setLabelCol("y").setFeaturesCol("features")
    ]).fit(data).stages[-1]
    x = np.array([[r[c] for c in COLUMNS] for r in data.collect()])
    scale = np.where(x.std(0) > 1e-9, x.std(0), np.inf)
    assert np.allclose(model.weights[:-1], fitted.coefficients.toArray() / scale, rtol=1e-5)
    assert model.weights[-1] == pytest.approx(fitted.intercept - (fitted.coefficients.toArray() / scale) @ x.mean(0), rel=1e-5)


def test_folds_with_one_class_outside_or_in_calibration(spark):
    rows = [(0, 0, -1.0), (0, 1, 2.5), (1, 0, -2.0), (1, 1, 3.0), (2, 0, -3.0), (2, 0, -0.5)]
    data = spark.createDataFrame(rows, "fold int, y int, a double")
    found = margins.cross_predict(data, ["a"], "y", models.linear_svm(), "fold", 3, models.calibrator).collect()
    assert {r["fold"] for r in found if r["probability"] is None} == {0, 1}
    assert all(r["prediction"] == r["y"] for r in found)
    with pytest.raises(ValueError, match="both classes"):
        margins.cross_predict(data.filter("fold <> 0"), ["a"], "y", models.linear_svm(), "fold", 3, models.calibrator)


def test_margin_classifiers_of_all_subjects_take_few_jobs(spark):
    """One chain of jobs for all folds: the fits of ten left-out subjects one by one took about 12 000 jobs."""
    rng = np.random.default_rng(5)
    rows = [(k, int(k >= 5), *map(float, rng.normal(size=4))) for k in range(10)]
    subjects = spark.createDataFrame(rows, "subject_id long, label int, a double, b double, c double, d double")
    data = folds.leave_one_out(subjects, ["subject_id"])
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    found = models.cross_validate(data, ["a", "b", "c", "d"], "label", {"svm": models.linear_svm()}, keep=["subject_id"])
    assert scheduler.numTotalJobs() - before < 1500
    assert found.count() == 10 and found.filter("probability IS NULL").count() == 0
