"""Queries for class statistics, feature selection, cross-validation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinespark.operators import boosting, dataset, folds, models, network, statistics, timedomain, windows
from kinespark.operators.layout import enumerate_rows
from kinespark.plans import classification, scoring, training
from kinespark.plans import sql_parts as S
from kinespark.plans.dataset_queries import detection, detection_windows_by_supplier
from kinespark.plans.registry import query, r, rounded, with_
from kinespark.plans.views import SUBJECT, samples, staged_signal, table
from kinespark.session import stage, stage_path

_LABELS = "SELECT d.source AS model, l.doc_id, l.quality AS label, l.toxic AS prediction FROM labels l JOIN documents d USING (doc_id)"


def _predictions(spark, sf_dir):
    """Document labels as true class and prediction; the document's source stands for the model."""
    labels = table(spark, sf_dir, "labels")
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"))
    return labels.join(sources, "doc_id").select(
        "model", "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


@query("class_balance", "SELECT quality, count(*) AS count FROM labels GROUP BY quality")
def class_balance(spark, sf_dir):
    return statistics.class_balance(table(spark, sf_dir, "labels"), "quality")


@query(
    "confusion_matrix",
    f"SELECT model, label, count(CASE WHEN prediction = 0 THEN 1 END) AS predicted_0,"
    f" count(CASE WHEN prediction = 1 THEN 1 END) AS predicted_1 FROM ({_LABELS}) GROUP BY model, label",
)
def confusion_matrix(spark, sf_dir):
    return statistics.confusion_matrix(_predictions(spark, sf_dir), by=["model"])


_REPORT = (
    f"WITH c AS (SELECT model, count(CASE WHEN label = prediction THEN 1 END) AS ok, count(*) AS n,"
    f" count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS hit, count(CASE WHEN prediction = 1 THEN 1 END) AS found,"
    f" count(CASE WHEN label = 1 THEN 1 END) AS actual FROM ({_LABELS}) GROUP BY model)"
    " SELECT model, " + r("ok / CAST(n AS DOUBLE)", "accuracy") + ", "
    + r("coalesce(2.0 * hit / CAST(nullif(found + actual, 0) AS DOUBLE), 0)", "f1") + ", "
    + r("coalesce(hit / CAST(nullif(found, 0) AS DOUBLE), 0)", "precision") + ", "
    + r("coalesce(hit / CAST(nullif(actual, 0) AS DOUBLE), 0)", "recall") + " FROM c"
)


@query("classification_report", _REPORT)
def classification_report(spark, sf_dir):
    """Accuracy, and F1, precision and recall of class 1."""
    return rounded(models.compare_models(_predictions(spark, sf_dir), "label"))


@query(
    "fold_accuracies",
    f"WITH f AS (SELECT model, doc_id % 5 AS fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM ({_LABELS})"
    " GROUP BY model, doc_id % 5) SELECT model, " + r("avg(a)", "mean_accuracy") + ", " + r("stddev_pop(a)", "std_accuracy")
    + ", CAST(count(*) AS INTEGER) AS folds, " + r("arg_min(a, fold)", "first_fold") + " FROM f GROUP BY model",
)
def fold_accuracies(spark, sf_dir):
    """Mean and spread of the accuracies of five folds."""
    rows = _predictions(spark, sf_dir).withColumn("fold", F.col("doc_id") % 5)
    found = statistics.fold_accuracies(rows, by=["model"])
    return rounded(
        found.select(
            "model", "mean_accuracy", "std_accuracy", F.size("fold_accuracies").alias("folds"),
            F.get("fold_accuracies", F.lit(0)).alias("first_fold"),
        )
    )


def _wide_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"e{i:02d}" for i in range(64)]
    return vectors.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


_CELLS = (
    "WITH cells AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM"
    " (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
)


@query(
    "correlation_matrix",
    _CELLS + " SELECT a.name AS row_name, b.name AS column_name, "
    + r("covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0)", "r")
    + " FROM cells a JOIN cells b USING (vec_id) GROUP BY a.name, b.name",
)
def correlation_matrix(spark, sf_dir):
    """Pearson r between all 64 dimensions."""
    wide, names = _wide_embeddings(spark, sf_dir)
    return rounded(statistics.correlation_matrix(wide, names))


@query(
    "point_biserial",
    _CELLS + " SELECT name AS feature, "
    + r("covar_pop(CASE WHEN label < 5 THEN 0.0 ELSE 1.0 END, v) / nullif(stddev_pop(CASE WHEN label < 5 THEN 0.0 ELSE 1.0 END)"
        " * stddev_pop(v), 0)", "correlation") + " FROM cells GROUP BY name",
)
def point_biserial(spark, sf_dir):
    """Correlation of each dimension with a two-class label."""
    return rounded(_point_biserial(spark, sf_dir).drop("p_value"))


def _point_biserial(spark, sf_dir):
    wide, names = _wide_embeddings(spark, sf_dir)
    rows = wide.withColumn("class", F.when(F.col("label") < 5, 0).otherwise(1))
    return statistics.point_biserial(rows, "class", names)


# two-sided p-value: the tail of (1 − x²)^((n−4)/2) beyond |r|, by Simpson's rule after x = sin(t)
_P_SQL = (
    _CELLS + """,
report AS (
  SELECT name AS feature, count(v) AS n,
         covar_pop(CASE WHEN label < 5 THEN 0.0 ELSE 1.0 END, v) / nullif(stddev_pop(CASE WHEN label < 5 THEN 0.0 ELSE 1.0 END)
         * stddev_pop(v), 0) AS r FROM cells GROUP BY name),
steps AS (
  SELECT feature, r, n, asin(abs(r)) AS t0, (pi() / 2 - asin(abs(r))) / 4000 AS h, i FROM report, range(4001) s(i)),
tails AS (
  SELECT feature, r, any_value(n) AS n,
         any_value(h) / 3 * sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                                * greatest(cos(t0 + i * h), 0) ** (n - 3)) AS area
  FROM steps GROUP BY feature, r)
"""
    + "SELECT * FROM (SELECT feature, " + r("r", "correlation") + ", "
    + r("2 * area * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi())", "p_value") + " FROM tails) WHERE p_value < 0.05"
)


@query("significant_features", _P_SQL)
def significant_features(spark, sf_dir):
    """Dimensions whose correlation has a p-value below 0.05."""
    return rounded(statistics.significant(_point_biserial(spark, sf_dir)))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_numbers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in _NUMBERS]
    )


@query(
    "standardised_columns",
    "WITH s AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _NUMBERS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(r(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c}", c) for c in _NUMBERS)
    + " FROM lineitem, s",
)
def standardised_columns(spark, sf_dir):
    """Columns with mean 0 and population standard deviation 1."""
    return rounded(statistics.standardise(_line_numbers(spark, sf_dir), _NUMBERS))


def _principal_sql() -> str:
    """Both axes of the correlation matrix: squared again and again, a matrix tends to the projector on its first axis."""
    n = len(_NUMBERS)
    z = [f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () AS z{i}" for i, c in enumerate(_NUMBERS)]
    cells = ", ".join(f"avg(z{i} * z{j})" for i in range(n) for j in range(n))

    def product(a: str, b: str) -> str:
        return "[" + ", ".join(
            "(" + " + ".join(f"{a}[{n * i + k + 1}] * {b}[{n * k + j + 1}]" for k in range(n)) + ")" for i in range(n) for j in range(n)
        ) + "]"

    def trace(m: str) -> str:
        return "(" + " + ".join(f"{m}[{(n + 1) * i + 1}]" for i in range(n)) + ")"

    def limit(name: str, source: str) -> str:
        return f"""{name}_walk AS (
  SELECT 0 AS step, m FROM {source}
  UNION ALL
  SELECT step + 1, list_transform(s, lambda x: x / {trace("s")}) FROM (SELECT step, {product("m", "m")} AS s FROM {name}_walk WHERE step < 40)),
{name} AS (SELECT m AS p FROM {name}_walk WHERE step = 40)"""

    def axis(name: str) -> str:
        # the column of the projector that belongs to its largest diagonal element, with that loading positive
        best = f"list_position([{', '.join(f'p[{(n + 1) * i + 1}]' for i in range(n))}], greatest({', '.join(f'p[{(n + 1) * i + 1}]' for i in range(n))}))"
        return f"""{name}_axis AS (
  SELECT [{", ".join(f"p[{n * i} + k] / sqrt(p[{n + 1} * k - {n}])" for i in range(n))}] AS v FROM (SELECT p, {best} AS k FROM {name}))"""

    scores = [" + ".join(f"z{i} * {t}.v[{i + 1}]" for i in range(n)) for t in ("a", "b")]
    return with_(
        f"standard AS (SELECT l_orderkey, l_linenumber, {', '.join(z)} FROM lineitem)",
        f"matrix AS (SELECT [{cells}] AS m FROM standard)",
        limit("first", "matrix"), axis("first"),
        f"""rest AS (
  SELECT list_transform(range(1, {n * n + 1}), lambda i: m[i] - {trace(product("m", "p"))} * p[i]) AS m FROM matrix, first)""",
        limit("second", "rest"), axis("second"), recursive=True,
    ) + f"SELECT l_orderkey, l_linenumber, {r(scores[0], 'pc1', 4)}, {r(scores[1], 'pc2', 4)} FROM standard, first_axis a, second_axis b"


@query("principal_components", _principal_sql())
def principal_components(spark, sf_dir):
    """The standardised columns on their first two axes."""
    return rounded(models.principal_components(_line_numbers(spark, sf_dir), _NUMBERS, 2, ["l_orderkey", "l_linenumber"]), 4)


@query(
    "logistic_optimum",
    "SELECT name AS feature, CAST(0 AS DOUBLE) AS gradient FROM (VALUES " + ", ".join(f"('{c}')" for c in ["intercept", *_NUMBERS]) + ") c(name)",
)
def logistic_optimum(spark, sf_dir):
    """Mean gradient of the penalised log-loss at the fitted coefficients, by column: 0 at the optimum."""
    rows = _line_numbers(spark, sf_dir).join(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label")),
        ["l_orderkey", "l_linenumber"],
    )
    rows = stage(statistics.standardise(rows, _NUMBERS), "standard")
    model = models.fit(rows, _NUMBERS, "label", models.logistic_regression(1000, tolerance=1e-10))
    fitted, count = model.stages[-1], rows.count()
    weights = dict(zip(_NUMBERS, fitted.coefficients.toArray()))
    error = models.score(model, rows).withColumn("error", F.col("probability") - F.col("label"))
    mean = error.agg(F.avg("error").alias("intercept"), *[
        (F.avg(F.col("error") * F.col(c)) + weights[c] / count).alias(c) for c in _NUMBERS
    ])
    names = ["intercept", *_NUMBERS]
    return rounded(mean.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("gradient")) for c in names]))), 5)


@query(
    "group_folds",
    """WITH RECURSIVE sizes AS (
  SELECT l_suppkey, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS place FROM lineitem GROUP BY l_suppkey),
walk AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS BIGINT) AS l_suppkey, CAST(NULL AS BIGINT) AS spot
  UNION ALL
  SELECT s.place,
         list_transform(w.load, lambda x, i: x + CASE WHEN i = list_position(w.load, list_min(w.load)) THEN s.c ELSE 0 END),
         s.l_suppkey, list_position(w.load, list_min(w.load))
  FROM walk w JOIN sizes s ON s.place = w.place + 1)
SELECT l_suppkey, CAST(spot - 1 AS INTEGER) AS fold FROM walk WHERE place > 0""",
)
def group_folds(spark, sf_dir):
    """Five folds of about equal size that keep each supplier's rows together."""
    return folds.group_folds(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 5)


@query(
    "one_to_one_join",
    "SELECT s_suppkey, s_name, items FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS items FROM lineitem GROUP BY l_suppkey)"
    " USING (s_suppkey)",
)
def one_to_one_join(spark, sf_dir):
    """Two tables joined on a key that must be unique in both."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("items"))
    return dataset.join_one_to_one(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), items, ["s_suppkey"])


_PLACE = "CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 8) AS BIGINT) % 10000"


@query(
    "holdout_split",
    f"SELECT CASE WHEN {_PLACE} < 7500 THEN 'train' ELSE 'test' END AS table_name, count(*) AS rows,"
    f" CAST(2 AS INTEGER) AS columns FROM orders GROUP BY {_PLACE} < 7500",
)
def holdout_split(spark, sf_dir):
    """Rows in the training and the test part of a repeatable 75/25 split."""
    train, test = folds.holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return dataset.cohort_union([dataset.shape_report(train, "train"), dataset.shape_report(test, "test")])


FEATURES = windows.TIME_FEATURES

_TREE_EDGES = {"l_quantity": [5.0, 10.0, 20.0, 30.0, 40.0, 45.0], "l_extendedprice": [5e3, 1e4, 2e4, 4e4, 6e4, 8e4],
               "l_discount": [0.01, 0.03, 0.05, 0.08], "l_tax": [0.01, 0.02, 0.04, 0.06]}


def _grown(level: int, source: str) -> str:
    """Gains of all splits of one level, the best one per node, and the rows below it."""
    return f"""gains_{level} AS (
  SELECT node, f, c, e, any_value(g) AS g, any_value(h) AS h, sum(x) AS gl, sum(0.25) AS hl
  FROM (SELECT node, v, x, sum(x) OVER (PARTITION BY node) AS g, count(*) OVER (PARTITION BY node) * 0.25 AS h FROM {source}), edges
  WHERE v[f + 1] <= e GROUP BY node, f, c, e),
best_{level} AS (
  SELECT node, f, e FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, c) AS place
    FROM (SELECT *, round((gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2, 9) AS gain
          FROM gains_{level} WHERE hl >= 1 AND h - hl >= 1) WHERE gain > 1e-9)
  WHERE place = 1),
rows_{level + 1} AS (
  SELECT 2 * node + CASE WHEN v[f + 1] <= e THEN 1 ELSE 2 END AS node, v, x FROM {source} JOIN best_{level} USING (node))"""


@query(
    "boosted_tree",
    "WITH edges(f, c, e) AS (VALUES "
    + ", ".join(f"({f}, {c}, CAST({e} AS DOUBLE))" for f, cuts in enumerate(_TREE_EDGES.values()) for c, e in enumerate(cuts))
    + "), rows_0 AS (SELECT 0 AS node, [" + ", ".join(f"CAST({c} AS DOUBLE)" for c in _TREE_EDGES)
    + "] AS v, CASE WHEN l_returnflag = 'R' THEN -0.5 ELSE 0.5 END AS x FROM lineitem),\n"
    + ",\n".join(_grown(k, f"rows_{k}") for k in range(2))
    + " SELECT CAST(node AS INTEGER) AS node, CAST(coalesce(f, -1) AS INTEGER) AS feature, e AS edge, "
    + r("-sum(x) / (count(*) * 0.25 + 1)", "leaf")
    + " FROM (SELECT * FROM rows_0 UNION ALL SELECT * FROM rows_1 UNION ALL SELECT * FROM rows_2)"
    " LEFT JOIN (SELECT * FROM best_0 UNION ALL SELECT * FROM best_1) USING (node) GROUP BY node, f, e",
)
def boosted_tree(spark, sf_dir):
    """The first tree of second-order boosting, two levels deep: splits, and the value of every node as a leaf."""
    edges = list(_TREE_EDGES.values())
    rows = table(spark, sf_dir, "lineitem").select(
        *_TREE_EDGES, (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    settings = boosting.Boosting(rounds=1, depth=2)
    tree = boosting.grow(rows, list(_TREE_EDGES), "label", settings, edges=edges)[0].trees[0]
    reached = {0} | {c for k, f in enumerate(tree.feature) if f >= 0 for c in (2 * k + 1, 2 * k + 2)}
    nodes = [(k, f, edges[f][c] if f >= 0 else None, v) for k, (f, c, v) in enumerate(zip(tree.feature, tree.cut, tree.leaf)) if k in reached]
    return rounded(spark.createDataFrame(nodes, "node int, feature int, edge double, leaf double"))


def training_windows(spark, sf_dir, label):
    """Labelled windows of all suppliers, with a fold per supplier."""
    found = stage(detection_windows_by_supplier(spark, sf_dir), "training")
    found = found.filter(F.col(label).isin(0, 1))
    return folds.with_folds(found, ["l_suppkey"], 5, "window_id")


def _compare(spark, sf_dir, label, columns, candidates):
    data = training_windows(spark, sf_dir, label)
    predictions = models.cross_validate(data, columns, label, candidates, keep=["l_suppkey", "window_id"])
    return models.compare_models(predictions, label)


@query("window_models_strict")
def window_models_strict(spark, sf_dir):
    """Grouped five-fold comparison of all six classifiers on the strict label."""
    return rounded(_compare(spark, sf_dir, "label_strict", FEATURES, models.window_models()))


@query("window_models_moderate")
def window_models_moderate(spark, sf_dir):
    return rounded(_compare(spark, sf_dir, "label_moderate", FEATURES, models.window_models()))


@query("window_models_lenient")
def window_models_lenient(spark, sf_dir):
    return rounded(_compare(spark, sf_dir, "label_lenient", FEATURES, models.window_models()))


@query("boosted_and_neural_models")
def boosted_and_neural_models(spark, sf_dir):
    """Gradient boosting, boosted trees and the perceptron on the two stride features, moderate label."""
    every = models.window_models()
    chosen = {name: every[name] for name in ("Gradient Boosting", "Boosted Trees", "MLP")}
    return rounded(_compare(spark, sf_dir, "label_moderate", windows.ASYMMETRY_FEATURES, chosen))


@query("asymmetry_models")
def asymmetry_models(spark, sf_dir):
    """Classifiers on the two stride features, lenient label."""
    return rounded(_compare(spark, sf_dir, "label_lenient", windows.ASYMMETRY_FEATURES, models.asymmetry_models()))


@query("raw_window_network")
def raw_window_network(spark, sf_dir):
    """A shallow network on flattened raw windows of twelve channels, five folds of subjects, moderate label."""
    found = detection(spark, sf_dir, windows.CHANNELS, "xyz").filter(F.col("label_moderate").isin(0, 1))
    found = stage(found.select(*SUBJECT, "window_id", "label_moderate", "x"), "windows")
    data = folds.with_folds(found, SUBJECT, 5, "window_id")
    predictions = network.cross_predict(data, "x", "label_moderate", [*SUBJECT, "window_id"], "fold")
    return rounded(models.compare_models(predictions.withColumn("model", F.lit("Shallow network")), "label_moderate"))


@query("embedding_network")
def embedding_network(spark, sf_dir):
    """The same on the embeddings as windows of 16 samples and 4 channels, for the upper half of their labels."""
    rows = table(spark, sf_dir, "embeddings")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    data = rows.select(
        "vec_id", (F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("label") >= 5).cast("int").alias("label"), matrix.alias("x")
    )
    predictions = network.cross_predict(data, "x", "label", ["vec_id"], "fold")
    return rounded(models.compare_models(predictions.withColumn("model", F.lit("Shallow network")), "label"))


EXTREMES = ["right_z_min", "left_z_min", "right_z_max", "left_z_max"]


def _subjects(spark, sf_dir):
    rows = timedomain.extremes(samples(spark, sf_dir), SUBJECT)
    return stage(rows.withColumn("label", F.when(F.col("subject_id") < 5, 0).otherwise(1)), "subjects")


@query("subject_models")
def subject_models(spark, sf_dir):
    """Leave-one-subject-out accuracy of three classifiers on the four extremes."""
    data = folds.leave_one_out(_subjects(spark, sf_dir), SUBJECT)
    predictions = models.cross_validate(data, EXTREMES, "label", models.subject_models(), keep=SUBJECT)
    found = statistics.fold_accuracies(predictions, by=["model"])
    return rounded(found.orderBy(F.desc("mean_accuracy"), "model"))


@query("subject_scores")
def subject_scores(spark, sf_dir):
    """Class and probability per subject from a model that was fitted, saved and loaded again."""
    data = _subjects(spark, sf_dir)
    path = stage_path(spark, models.artefact_name("classification", "label", "Logistic Regression"))
    models.save(models.fit(data, EXTREMES, "label", models.logistic_regression(100)), path)
    return rounded(models.score(models.load(path), data))


@query("recording_scores")
def recording_scores(spark, sf_dir):
    """Whole recordings scored from their extremes, suppliers as subjects: linear margins with calibrated probabilities."""
    key = ["l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(
        *key, F.when(F.col("l_orderkey") % 2 == 0, "left").otherwise("right").alias("side"),
        (F.col("l_extendedprice").cast("double") / 1000 - 25).alias("z"),
    )
    rows = stage(rows, "recordings")
    record = stage(timedomain.extremes(rows, key).withColumn("label", (F.col("right_z_max") > F.col("left_z_max")).cast("int")), "extremes")
    return rounded(scoring.score_recordings(rows, key, models.fit(record, EXTREMES, "label", models.linear_svm())))


@query("forest_importance")
def forest_importance(spark, sf_dir):
    """Importance of the window features, joined with their elimination rank."""
    train, _ = folds.holdout(training_windows(spark, sf_dir, "label_moderate"), ["l_suppkey"])
    train = stage(train, "train")
    importance = models.forest_importance(train, FEATURES, "label_moderate")
    ranks = models.recursive_elimination(train, FEATURES, "label_moderate", 4)
    return rounded(dataset.join_one_to_one(importance, ranks, ["feature"]).orderBy("ranking", "feature"))


def supplier_subjects(spark, sf_dir):
    """The 56 features of every supplier as a subject: shipments of even and odd orders are its two sides."""
    key = ["l_suppkey"]
    seconds = F.make_dt_interval(secs=(F.col("l_orderkey") % 86_400).cast("decimal(18,6)"))
    rows = table(spark, sf_dir, "lineitem").select(
        *key, "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, "left").otherwise("right").alias("side"),
        (F.col("l_shipdate").cast("timestamp_ntz") + seconds).alias("ts"), (F.col("l_quantity").cast("double") - 25.5).alias("z"),
    )
    series = enumerate_rows(rows, [*key, "side"], ["ts", "l_orderkey", "l_linenumber"])
    series = stage(series.withColumn("elapsed", F.col("n") / 100.0).drop("l_orderkey", "l_linenumber"), "series")
    spine = series.select(*key).distinct().withColumn("label", (F.col("l_suppkey") % 2).cast("int"))
    settings = classification.FeatureSettings(window_s=120 * 86_400.0, stride_height=0.5, stride_distance=10)
    return classification.subject_features(series, spine, key, settings)


@query("feature_elimination")
def feature_elimination(spark, sf_dir):
    """Importance of all 56 subject features and their rank in an elimination one by one down to ten, with 100 trees each."""
    subjects = stage(supplier_subjects(spark, sf_dir).na.fill(0.0), "subjects")
    names = [c for c in subjects.columns if c not in ("l_suppkey", "label")]
    train, _ = folds.holdout(subjects, ["l_suppkey"])
    train = stage(train, "train")
    importance = models.forest_importance(train, names, "label")
    ranks = models.recursive_elimination(train, names, "label", 10)
    return rounded(dataset.join_one_to_one(importance, ranks, ["feature"]).orderBy("ranking", "feature"))


@query("best_asymmetry_model")
def best_asymmetry_model(spark, sf_dir):
    """The best classifier on the stride features, refitted on all windows, stored, loaded again and used on every window."""
    found = stage(detection_windows_by_supplier(spark, sf_dir), "training")
    path, label, columns = stage_path(spark, "models"), "label_lenient", windows.ASYMMETRY_FEATURES
    trained = training.train_window_classifier(found, columns, label, models.asymmetry_models(), ["l_suppkey"], path=path)
    loaded = models.load(f"{path}/{models.artefact_name('detection', label, trained.name)}")
    scored = models.score(loaded, found.na.drop(subset=columns))
    return rounded(scored.select("l_suppkey", "window_id", F.lit(trained.name).alias("model"), label, "probability", "prediction"))


_KEYS = "subject_id, side"


@query(
    "stride_measures",
    with_(
        S.SIGNAL, S.maxima("signal", _KEYS, height=scoring.LIVE_HEIGHT), S.thinned("maxima", _KEYS, scoring.LIVE_DISTANCE),
        S.numbered_strides("thinned", _KEYS),
        """pairs AS (
  SELECT l.subject_id, (l.stride_samples - r.stride_samples) / CAST(l.stride_samples + r.stride_samples AS DOUBLE) AS a,
         least(l.stride_samples, r.stride_samples) / CAST(greatest(l.stride_samples, r.stride_samples) AS DOUBLE) AS s
  FROM strides l JOIN strides r ON l.subject_id = r.subject_id AND l.stride_no = r.stride_no AND l.side = 'left' AND r.side = 'right')""",
        recursive=True,
    )
    + "SELECT subject_id, " + r("coalesce(avg(a), 0)", windows.ASYMMETRY_FEATURES[0]) + ", "
    + r("coalesce(avg(s), 0)", windows.ASYMMETRY_FEATURES[1])
    + " FROM (SELECT DISTINCT subject_id FROM signal) LEFT JOIN pairs USING (subject_id) GROUP BY subject_id",
)
def stride_measures(spark, sf_dir):
    """Mean stride asymmetry and symmetry per recording, 0 where no strides pair up."""
    return rounded(scoring.stride_measures(staged_signal(spark, sf_dir), SUBJECT))


@query("stride_scores")
def stride_scores(spark, sf_dir):
    """Recordings classified by their stride measures, with a model fitted on labelled windows."""
    train = training_windows(spark, sf_dir, "label_lenient")
    model = models.fit(train, windows.ASYMMETRY_FEATURES, "label_lenient", models.random_forest(100))
    return rounded(scoring.score_strides(staged_signal(spark, sf_dir), SUBJECT, model))
