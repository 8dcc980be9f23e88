import os

from pyspark.sql import functions as F

from kinespark.operators import models, windows
from kinespark.plans import scoring, training
from kinespark.session import clear_stages, stage, stage_root
from kinespark.streaming import live


def window_table(spark):
    """Windows of eight subjects whose features follow the label."""
    subjects = spark.range(8).select(
        F.when(F.col("id") % 2 == 0, "Healthy").otherwise("Stroke").alias("cohort"), F.col("id").cast("string").alias("subject_id")
    )
    rows = subjects.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("window_id"))
    a = F.pmod(F.xxhash64("subject_id", "window_id"), F.lit(100)) / 250
    asymmetry, symmetry = windows.ASYMMETRY_FEATURES
    rows = rows.withColumn(asymmetry, a).withColumn(symmetry, (1 - a) / (1 + a))
    for name, (high, low) in windows.LABEL_LIMITS.items():
        label = F.when(F.col("window_id") == 11, 2).when((F.abs(a) > high) | (F.col(symmetry) < low), 1).otherwise(0)
        rows = rows.withColumn(f"label_{name}", label)
    return stage(rows)


def test_every_label_gets_a_report_and_a_stored_model(spark, tmp_path):
    candidates = {"RandomForest": models.random_forest(10), "LogisticRegression": models.logistic_regression(30)}
    data = window_table(spark)
    found = training.train_all_labels(data, windows.ASYMMETRY_FEATURES, candidates, str(tmp_path), n_folds=4)
    assert set(found) == set(windows.LABELS)
    for label, trained in found.items():
        assert trained.predictions.count() == 2 * 8 * 11
        best = max(r["f1"] for r in trained.comparison.collect())
        assert trained.comparison.filter(F.col("model") == trained.name).first()["f1"] == best > 0.8
        name = models.artefact_name("detection", label, trained.name)
        assert os.path.isdir(tmp_path / name) and os.path.isdir(tmp_path / f"{name}_comparison")
        loaded = models.load(str(tmp_path / name))
        assert models.score(loaded, data).count() == data.count()


def test_subject_classifier_and_recording_scores(spark, tmp_path):
    rows = [
        (c, f"p{i}", s, n, float((n % 25 - 12) * (40 if c == "Healthy" else 12) + i))
        for c in ("Healthy", "Stroke") for i in range(3) for s in ("left", "right") for n in range(200)
    ]
    series = spark.createDataFrame(rows, "cohort string, subject_id string, side string, n long, z double")
    from kinespark.operators.timedomain import extremes

    record = extremes(series, training.SUBJECT).withColumn("label", F.when(F.col("cohort") == "Healthy", 0).otherwise(1))
    candidates = {"Logistic Regression": models.logistic_regression(50), "Random Forest": models.random_forest(5)}
    trained = training.train_subject_classifier(record, candidates=candidates, path=str(tmp_path))
    scores = {(r["cohort"], r["subject_id"]): r for r in scoring.score_recordings(series, training.SUBJECT, trained.model).collect()}
    assert len(scores) == 6
    assert all(r["prediction"] == int(cohort == "Stroke") for (cohort, _), r in scores.items())
    assert trained.comparison.first()["mean_accuracy"] == 1.0 and len(trained.comparison.first()["fold_accuracies"]) == 6

    measures = scoring.stride_measures(series, training.SUBJECT).collect()
    assert all(r["gyro_asymmetry_stride_times"] == 0 and r["gyro_symmetry_ratio_stride_times"] == 1 for r in measures)


def test_alerts_and_scores_of_windows(spark):
    data = window_table(spark)
    labelled = data.filter("label_lenient <> 2")
    model = models.fit(labelled, windows.ASYMMETRY_FEATURES, "label_lenient", models.random_forest(10))
    assert live.symmetry_alerts(data).count() == data.filter("gyro_symmetry_ratio_stride_times < 0.9").count() > 0
    right = models.score(model, labelled).filter("prediction = label_lenient").count()
    assert right > 0.9 * labelled.count()


def test_staged_tables_lie_in_the_configured_folder(spark):
    df = stage(spark.range(5))
    path = df.inputFiles()[0]
    assert stage_root(spark).removeprefix("file:") in path and spark.sparkContext.applicationId in path
    assert callable(clear_stages)
