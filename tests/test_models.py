import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions.student import p_value
from kinespark.operators import folds, models, statistics


@pytest.fixture(scope="module")
def labelled(spark):
    """Two separable classes over 12 groups."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        for i in range(8 + g):
            y = (g + i) % 2
            rows.append((f"g{g:02d}", i, y, float(y * 4 + rng.normal()), float(rng.normal()), float(rng.normal() * 3)))
    return spark.createDataFrame(rows, "grp string, i int, y int, good double, noise double, wide double").cache()


def fold_walk(sizes, folds):
    """Largest group first, each to the fold with the fewest rows."""
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out, load


def test_no_group_is_in_two_folds_and_folds_are_even(spark, labelled):
    sizes = {r["grp"]: r["count"] for r in labelled.groupBy("grp").count().collect()}
    found = {r["grp"]: r["fold"] for r in folds.group_folds(labelled, ["grp"], 5).collect()}
    expected, load = fold_walk(sizes, 5)
    assert found == expected
    assert max(load) - min(load) <= max(sizes.values())
    with pytest.raises(ValueError):
        folds.group_folds(labelled, ["grp"], 13)


def test_folds_follow_one_rule_however_many_groups(spark):
    """Runs of equal sizes after larger ones, ranked by a window and by ranges."""
    counts = [50, 30, 20, 9, 8, 7, 7, 7, 7, 7, 7, 7, 3, 3] + [1] * 60
    sizes = {f"g{k:02d}": n for k, n in enumerate(counts)}
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "grp string")
    for limit in (2_000_000, 4):
        found = {r["grp"]: r["fold"] for r in folds.group_folds(rows, ["grp"], 5, limit=limit).collect()}
        assert found == fold_walk(sizes, 5)[0]


def test_pieces_of_the_walk_equal_single_steps():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, top = int(rng.integers(1, 8)), int(rng.integers(1, 60))
        load, single = [0] * n, [0] * n
        for size in sorted({int(x) for x in rng.integers(1, top + 1, 6)}, reverse=True):
            groups = int(rng.integers(1, 40))
            pieces = folds.walk(load, size, groups)
            assert len(pieces) <= n and [p[0] for p in pieces] == [0, *[p[1] for p in pieces[:-1]]]
            got = [c[k % len(c)] for a, b, c in pieces for k in range(b - a)]
            for fold in got:
                assert fold == single.index(min(single))
                single[fold] += size
            assert len(got) == groups and load == single


def test_leave_one_out(labelled):
    out = folds.leave_one_out(labelled, ["grp"])
    assert out.count() == labelled.count()
    assert out.select("grp", "fold").distinct().count() == 12


def test_holdout_is_repeatable_and_keeps_keys_apart(spark):
    df = spark.range(4000).selectExpr("id", "id % 1000 AS k")
    train, test = folds.holdout(df, ["k"])
    assert train.count() + test.count() == 4000
    assert train.join(test, "k", "left_semi").count() == 0
    assert 0.7 < train.count() / 4000 < 0.8
    assert sorted(train.collect()) == sorted(folds.holdout(df.repartition(7), ["k"])[0].collect())


@pytest.mark.parametrize("r,n,expected", [
    # two-sided values of Student's t: t = 2.228139 with 10, 1.959966 with very many degrees of freedom
    (np.sqrt(2.2281388520**2 / (2.2281388520**2 + 10)), 12, 0.05),
    (np.sqrt(12.7062047364**2 / (12.7062047364**2 + 1)), 3, 0.05),
    (0.0, 30, 1.0), (1.0, 10, 0.0), (np.sqrt(1.9599639845**2 / (1.9599639845**2 + 10**7)), 10**7 + 2, 0.05),
])
def test_p_values(r, n, expected):
    assert p_value(float(r), n) == pytest.approx(expected, abs=1e-7)


def test_correlations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x[:, 2] = 7
    y = rng.integers(0, 2, 60)
    rows = [(int(c), *[float(v) for v in row]) for c, row in zip(y, x)]
    df = spark.createDataFrame(rows, "y int, a double, b double, constant double, d double")
    df = df.withColumn("b", F.when(F.col("a") < 1, F.col("b")))
    matrix = {(r[0], r[1]): r[2] for r in statistics.correlation_matrix(df, ["a", "b", "constant", "d"]).collect()}
    assert len(matrix) == 16 and matrix[("constant", "a")] is None and matrix[("a", "a")] == pytest.approx(1)
    both = x[:, 0] < 1
    assert matrix[("b", "d")] == pytest.approx(np.corrcoef(x[both, 1], x[both, 3])[0, 1])
    report = {r["feature"]: r for r in statistics.point_biserial(df, "y", ["a", "d", "constant"]).collect()}
    assert report["a"]["correlation"] == pytest.approx(np.corrcoef(y, x[:, 0])[0, 1])
    assert report["constant"]["p_value"] is None and 0 < report["d"]["p_value"] <= 1


def test_scaling_and_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i int, a double, b double, c double")
    z = (x - x.mean(0)) / x.std(0)
    scaled = statistics.standardise(df, ["a", "b", "c"]).orderBy("i").collect()
    assert np.allclose([[r["a"], r["b"], r["c"]] for r in scaled], z)
    found = models.principal_components(df, ["a", "b", "c"], 2, ["i"]).orderBy("i").collect()
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    for k in range(2):
        v = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([r[f"pc{k + 1}"] for r in found], z @ v)


def test_report_metrics(spark):
    rows = [("m", 1, 1)] * 6 + [("m", 1, 0)] * 2 + [("m", 0, 1)] * 3 + [("m", 0, 0)] * 9 + [("never", 1, 0)] * 2 + [("never", 0, 0)] * 2
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    found = {r["model"]: r for r in models.compare_models(df, "label").collect()}
    m = found["m"]
    assert (m["accuracy"], m["precision"], m["recall"]) == pytest.approx((15 / 20, 6 / 9, 6 / 8))
    assert m["f1"] == pytest.approx(12 / 17)
    assert (found["never"]["precision"], found["never"]["f1"]) == (0.0, 0.0)
    counts = {(r["model"], r["label"]): (r["predicted_0"], r["predicted_1"]) for r in statistics.confusion_matrix(df, by=["model"]).collect()}
    assert counts[("m", 1)] == (2, 6) and counts[("m", 0)] == (9, 3) and counts[("never", 1)] == (2, 0)


def test_best_model_breaks_ties_by_declared_order(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.5)], "model string, f1 double")
    assert models.best_model(df, "f1", ["a", "b", "c"]) == "a"
    assert models.best_model(df, "f1", ["c", "b", "a"]) == "b"
    assert models.artefact_name("detection", "label_strict", "SVM (linear)") == "detection_strict_svm_(linear)"


def test_cross_validation_and_saved_model(spark, labelled, tmp_path):
    data = folds.with_folds(labelled, ["grp"], 3, "i")
    candidates = {
        "lr": models.logistic_regression(50), "rf": models.random_forest(5), "svm": models.linear_svm(20),
        "gbt": models.gradient_boosting(20), "mlp": models.perceptron(4, 20),
    }
    predictions = models.cross_validate(data, ["good", "noise"], "y", candidates, keep=["grp", "i"])
    assert predictions.groupBy("model", "grp", "i").count().filter("count <> 1").count() == 0
    assert predictions.count() == 5 * labelled.count()
    report = {r["model"]: r for r in models.compare_models(predictions, "y").collect()}
    assert report["lr"]["accuracy"] > 0.9 and report["svm"]["accuracy"] > 0.9 and report["gbt"]["accuracy"] > 0.85
    assert predictions.filter("probability IS NULL").count() == 0

    model = models.fit(labelled, ["good", "noise"], "y", models.logistic_regression(50))
    models.save(model, str(tmp_path / "m"))
    again = models.score(models.load(str(tmp_path / "m")), labelled)
    assert sorted(again.collect()) == sorted(models.score(model, labelled).collect())
    assert again.filter((F.col("probability") >= 0.5).cast("int") != F.col("prediction")).count() == 0
    strict = models.score(model, labelled, cut=0.99).filter("prediction = 1").count()
    assert strict < again.filter("prediction = 1").count()


def test_importance_and_elimination(labelled):
    names = ["noise", "good", "wide"]
    importance = models.forest_importance(labelled, names, "y", models.random_forest(10)).collect()
    assert importance[0]["feature"] == "good" and sum(r["importance"] for r in importance) == pytest.approx(1)
    ranks = models.recursive_elimination(labelled, names, "y", 1, factory=models.random_forest(10)).collect()
    assert [r["ranking"] for r in ranks] == [1, 2, 3]
    assert (ranks[0]["feature"], ranks[0]["selected_by_rfe"]) == ("good", True)


@pytest.mark.parametrize("n", [10**6, 10**9, 10**12])
def test_p_values_of_many_rows(n):
    import math

    from kinespark.functions.student import p_value

    for t in (0.3, 1.0, 2.0, 4.5):
        r = t / math.sqrt(n - 2 + t * t)
        assert p_value(r, n) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=5e-6)


def test_small_tables_of_a_forest_are_spread():
    assert [models.forest_partitions(n) for n in (4_000, 20_000, 200_000, 6_400_000)] == [1, 5, 32, 128]
