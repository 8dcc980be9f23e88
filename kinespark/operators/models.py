"""Classifiers, feature selection and cross-validation on MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kinespark.operators import boosting, forest, margins
from kinespark.operators.boosting import Boosted, Boosting
from kinespark.operators.statistics import classification_report
from kinespark.session import stage

SEED = 42
TRAIN_ROWS = 50_000
FOREST_ROWS, FOREST_PARTS = 4_000, 32  # a forest reads its rows once a level, so even a small table is spread
BOOSTED_FOLDER = "boosted"

# an estimator for (number of features, number of training rows), or the settings of boosted trees
Factory = Callable[[int, int], object] | Boosting
INNER_FOLDS = 3  # over which a margin classifier is calibrated


def logistic_regression(max_iter: int = 1000, c: float = 1.0, tolerance: float = 1e-4) -> Factory:
    """L2 penalty with inverse strength ``c``, on the features as given."""
    return lambda width, rows: LogisticRegression(
        regParam=1 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tolerance
    )


def random_forest(trees: int = 100, depth: int = 30) -> Factory:
    """The node that each row has reached in each tree is kept, so that no level walks down the trees again."""
    return lambda width, rows: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True)


def linear_svm(max_iter: int = 100, c: float = 1.0) -> Factory:
    return lambda width, rows: LinearSVC(regParam=1 / (c * rows), standardization=False, maxIter=max_iter, tol=1e-3)


def gradient_boosting(rounds: int = 100) -> Boosting:
    return boosting.first_order(rounds)


def boosted_trees(rounds: int = 100) -> Boosting:
    """Second-order boosting with deeper trees, larger steps and a penalty on the leaves."""
    return boosting.second_order(rounds)


def perceptron(hidden: int = 50, max_iter: int = 3000) -> Factory:
    return lambda width, rows: MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=max_iter, seed=SEED)


def subject_models() -> dict[str, Factory]:
    return {
        "Logistic Regression": logistic_regression(100),
        "Random Forest": random_forest(10),
        "SVM (Linear Kernel)": linear_svm(),
    }


def window_models(rounds: int = 100, perceptron_iterations: int = 3000) -> dict[str, Factory]:
    return {
        "Random Forest": random_forest(100),
        "Logistic Regression": logistic_regression(),
        "Gradient Boosting": gradient_boosting(rounds),
        "MLP": perceptron(50, perceptron_iterations),
        "SVM (linear)": linear_svm(),
        "Boosted Trees": boosted_trees(rounds),
    }


def asymmetry_models(rounds: int = 100) -> dict[str, Factory]:
    return {
        "LogisticRegression": logistic_regression(),
        "RandomForest": random_forest(100),
        "GradientBoosting": gradient_boosting(rounds),
    }


def scaling_stages(columns: Sequence[str], rows: int, output: str = "features") -> list:
    """Assemble the columns and scale them to mean 0 and population standard deviation 1."""
    width = len(columns)
    correction = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [
        VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([correction] * width), inputCol="_scaled", outputCol=output),
    ]


def fit(train: DataFrame, columns: Sequence[str], label: str, factory: Factory, groups: str | None = None) -> PipelineModel | Boosted:
    """Scaler and classifier as one pipeline, so that scoring always scales alike.

    A margin classifier is calibrated (:func:`calibrator`); ``groups`` numbers the subjects' folds for that.
    """
    if isinstance(factory, Boosting):
        return boosting.grow(train, columns, label, factory)[0]
    rows = train.count()

    def pipeline(df: DataFrame, size: int) -> PipelineModel:
        estimator = factory(len(columns), size).setLabelCol(label).setFeaturesCol("features")
        if isinstance(estimator, RandomForestClassifier) and size > FOREST_ROWS:
            df = df.select(label, *columns).repartition(forest_partitions(size))
        return Pipeline(stages=[*scaling_stages(columns, size), estimator]).fit(df)

    model = pipeline(train, rows)
    if isinstance(model.stages[-1], LinearSVCModel):
        held = held_out_margins(train, columns, label, pipeline, groups)
        if held is not None:
            slicer = VectorSlicer(inputCol="rawPrediction", outputCol="_margin", indices=[1])
            model = PipelineModel([*model.stages, slicer, calibrator(held, label)])
    return model


def forest_partitions(rows: int) -> int:
    """One per FOREST_ROWS rows up to FOREST_PARTS, and never more than TRAIN_ROWS rows in one."""
    return max(min(math.ceil(rows / FOREST_ROWS), FOREST_PARTS), math.ceil(rows / TRAIN_ROWS))


def held_out_margins(train: DataFrame, columns: Sequence[str], label: str, pipeline: Callable[[DataFrame, int], PipelineModel],
                     groups: str | None) -> DataFrame | None:
    """(label, margin) of every row from a model that has not seen the row's group; None unless both classes are there.

    Without ``groups`` rows are dealt by a hash of their features, so that equal rows stay together.
    """
    number = F.col(groups).cast("long") if groups else F.xxhash64(*columns)
    dealt = train.withColumn("_inner", F.pmod(number, F.lit(INNER_FOLDS)))
    classes = {(r["_inner"], r[label]): r["count"] for r in dealt.groupBy("_inner", label).count().collect()}

    def one(inner: int) -> DataFrame | None:
        others = [(y, n) for (i, y), n in classes.items() if i != inner]
        if len({y for y, _ in others}) < 2:
            return None
        model = pipeline(dealt.filter(F.col("_inner") != inner), sum(n for _, n in others))
        margin = vector_to_array("rawPrediction")[1]
        return model.transform(dealt.filter(F.col("_inner") == inner)).select(label, margin.alias("margin"))

    with ThreadPool(INNER_FOLDS) as pool:
        parts = [p for p in pool.map(one, sorted({i for i, _ in classes})) if p is not None]
    if not parts:
        return None
    held = stage(reduce(DataFrame.unionByName, parts), "margins")
    return held if held.select(label).distinct().count() == 2 else None


def calibrator(held: DataFrame, label: str) -> LogisticRegressionModel:
    """Sigmoid from margins to probabilities that grows with the margin (or stays level), fitted to log-loss.

    The classes' targets are (n + 1) / (n + 2) and 1 / (n + 2), which keeps the sigmoid finite where margins separate
    the classes; each row therefore counts for both classes, with these weights.
    """
    sizes = {r[label]: r["count"] for r in held.groupBy(label).count().collect()}
    target = F.when(F.col(label) == 1, (sizes[1] + 1) / (sizes[1] + 2)).otherwise(1 / (sizes[0] + 2))
    both = held.select("margin", F.inline(F.array(
        F.struct(F.lit(1).alias("_is"), target.alias("_weight")), F.struct(F.lit(0).alias("_is"), (1 - target).alias("_weight"))
    )))
    rows = VectorAssembler(inputCols=["margin"], outputCol="_margin").transform(both)
    return LogisticRegression(
        featuresCol="_margin", labelCol="_is", weightCol="_weight", predictionCol="_class", rawPredictionCol="_logit", tol=1e-9,
        maxIter=200, lowerBoundsOnCoefficients=DenseMatrix(1, 1, [0.0]),
    ).fit(rows)


def score(model: PipelineModel | Boosted, df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Add ``prediction`` (int) and ``probability`` of class 1.

    The class is 1 from a probability of ``cut`` on; a margin classifier decides by its sign, whatever its
    calibrated probability. Only a margin classifier that met a single class in calibration has no probability.
    """
    if isinstance(model, Boosted):
        return model.score(df, cut)
    scored = model.transform(df)
    by_margin = any(isinstance(s, LinearSVCModel) for s in model.stages)
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.lit(None).cast("double")
    decided = F.col("prediction") if by_margin else p >= cut
    return scored.select(*df.columns, p.alias("probability"), decided.cast("int").alias("prediction"))


def _for_training(df: DataFrame) -> DataFrame:
    """Stored and kept in memory, in partitions of about ``TRAIN_ROWS`` rows: every iteration of a
    solver is a job over all partitions, so a small table must not have many."""
    stored = stage(df, "training")
    partitions = max(1, math.ceil(stored.count() / TRAIN_ROWS))
    return stored.coalesce(partitions).persist(StorageLevel.MEMORY_AND_DISK)


def cross_validate(df: DataFrame, columns: Sequence[str], label: str, models: dict[str, Factory], fold: str = "fold",
                   keep: Sequence[str] = (), parallel: int = 16) -> DataFrame:
    """Out-of-fold predictions of every model, one row per input row and model.

    The scaler is fitted inside each training fold. Fits run ``parallel`` at a time, as
    cross-validation in MLlib does; boosted trees of all folds grow together, and so do margin classifiers with the ones
    that calibrate them (:mod:`margins`); as the longest chains of jobs they begin first. The result is stored.
    """
    data = _for_training(df.select(*dict.fromkeys([*keep, fold, label, *columns])))
    numbers = [row[0] for row in data.select(fold).distinct().orderBy(fold).collect()]

    def by_margin(factory: Factory) -> bool:
        return not isinstance(factory, Boosting) and isinstance(factory(len(columns), 2), LinearSVC)

    def one(task):
        name, number = task
        if isinstance(models[name], Boosting):
            predicted = boosting.cross_predict(data, columns, label, models[name], fold, numbers)
        elif number is None:
            predicted = margins.cross_predict(data, columns, label, models[name], fold, INNER_FOLDS, calibrator)
        else:
            model = fit(data.filter(F.col(fold) != number), columns, label, models[name], fold)
            predicted = score(model, data.filter(F.col(fold) == number))
        return predicted.withColumn("model", F.lit(name))

    tasks = [(n, k) for n, f in models.items() for k in ([None] if isinstance(f, Boosting) or by_margin(f) else numbers)]
    tasks.sort(key=lambda task: task[1] is not None)
    with ThreadPool(parallel) as pool:
        parts = pool.map(one, tasks, chunksize=1)
    out = list(dict.fromkeys([*keep, fold, label, "model", "prediction", "probability"]))
    predictions = stage(reduce(DataFrame.unionByName, [p.select(*out) for p in parts]), "predictions")
    data.unpersist()
    return predictions


def compare_models(predictions: DataFrame, label: str) -> DataFrame:
    """Metrics per model over the pooled predictions, best F1 first."""
    report = classification_report(predictions, label, by=["model"])
    return report.orderBy(F.desc("f1"), "model")


def best_model(comparison: DataFrame, metric: str, order: Sequence[str]) -> str:
    """Name of the best model; of equal ones the first in ``order``."""
    place = F.coalesce(*[F.when(F.col("model") == m, -i) for i, m in enumerate(order)])
    return comparison.agg(F.max_by("model", F.struct(F.col(metric), place))).first()[0]


def save(model: PipelineModel | Boosted, path: str, spark: SparkSession | None = None) -> None:
    if isinstance(model, Boosted):
        model.save(spark or SparkSession.active(), f"{path}/{BOOSTED_FOLDER}")
    else:
        model.write().overwrite().save(path)


def load(path: str, spark: SparkSession | None = None) -> PipelineModel | Boosted:
    spark = spark or SparkSession.active()
    boosted = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BOOSTED_FOLDER}")
    if boosted.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(boosted):
        return boosting.load(spark, f"{path}/{BOOSTED_FOLDER}")
    return PipelineModel.load(path)


def artefact_name(task: str, label: str, model: str) -> str:
    """('detection', 'label_strict', 'Random Forest') → 'detection_strict_random_forest'."""
    kind = label.split("_")[-1]
    return f"{task}_{kind}_{model.replace(' ', '_').lower()}"


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Projection of the standardised columns; each axis is turned so that its largest loading is positive."""
    rows = df.count()
    fitted = Pipeline(stages=[*scaling_stages(columns, rows), PCA(k=k, inputCol="features", outputCol="pcs")]).fit(df)
    loadings = fitted.stages[-1].pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    pcs = vector_to_array("pcs")
    return fitted.transform(df).select(*keep, *[(pcs[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def _importances(train: DataFrame, columns: Sequence[str], label: str, factory: Factory) -> Callable[[Sequence[str]], Sequence[float]]:
    """Gives the importances of some of the columns in a forest on them alone.

    Tables of more than FOREST_ROWS rows that a task can hold are read once for all forests (:mod:`forest`).
    """
    rows = train.count()
    settings = factory(len(columns), rows)
    small = FOREST_ROWS < rows <= forest.CELLS // len(columns)
    held = forest.held(train, columns, label, settings.getMaxBins()) if small else None

    def one(some: Sequence[str]) -> Sequence[float]:
        if held is None:
            return fit(train, some, label, factory).stages[-1].featureImportances.toArray()
        places = [columns.index(c) for c in some]
        return forest.importance(train.sparkSession, held[0][:, places], held[1], settings)

    return one


def forest_importance(train: DataFrame, columns: Sequence[str], label: str, factory: Factory | None = None) -> DataFrame:
    """Importance of each feature in a random forest, highest first."""
    weights = _importances(train, list(columns), label, factory or random_forest(100))(columns)
    rows = [(c, float(w)) for c, w in zip(columns, weights)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def recursive_elimination(train: DataFrame, columns: Sequence[str], label: str, wanted: int = 10, step: int = 1,
                          factory: Factory | None = None) -> DataFrame:
    """Refit and drop the ``step`` least important features until ``wanted`` are left.

    ``ranking`` is 1 for the selected features and grows towards the first ones dropped.
    """
    left = list(columns)
    rounds: list[list[str]] = []
    data = _for_training(train.select(label, *columns))
    importances = _importances(data, list(columns), label, factory or random_forest(100))
    while len(left) > wanted:
        importance = importances(left)
        drop = sorted(range(len(left)), key=lambda i: (importance[i], i))[: min(step, len(left) - wanted)]
        rounds.append([left[i] for i in drop])
        left = [c for i, c in enumerate(left) if i not in drop]
    data.unpersist()
    ranking = {c: 1 for c in left}
    for age, dropped in enumerate(reversed(rounds)):
        ranking.update({c: age + 2 for c in dropped})
    rows = [(c, ranking[c] == 1, ranking[c]) for c in columns]
    return train.sparkSession.createDataFrame(rows, "feature string, selected_by_rfe boolean, ranking int").orderBy(
        "ranking", "feature"
    )
