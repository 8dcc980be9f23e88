"""Class counts, confusion counts, report metrics, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.scalar import correlation
from kinespark.functions.student import correlation_p_value

METRICS = ("accuracy", "f1", "precision", "recall")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, most frequent first."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """One row per true class with the number of rows predicted as 0 and as 1."""
    def predicted(value):
        return F.count_if(F.col(prediction) == value).alias(f"predicted_{value}")

    return df.groupBy(*by, label).agg(predicted(0), predicted(1))


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and F1, precision and recall of class 1, over all (pooled) predictions."""
    true, found = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(label) == F.col(prediction)).alias("_right"), F.count("*").alias("_all"),
        F.count_if(true & found).alias("_hit"), F.count_if(found).alias("_found"), F.count_if(true).alias("_true"),
    )
    return counts.select(
        *by,
        _ratio(F.col("_right"), F.col("_all")).alias("accuracy"),
        _ratio(2 * F.col("_hit"), F.col("_found") + F.col("_true")).alias("f1"),
        _ratio(F.col("_hit"), F.col("_found")).alias("precision"),
        _ratio(F.col("_hit"), F.col("_true")).alias("recall"),
    )


def fold_accuracies(df: DataFrame, fold: str = "fold", label: str = "label", prediction: str = "prediction",
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of the folds' accuracies, and their list in fold order."""
    per_fold = df.groupBy(*by, fold).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy")
    )
    ordered = F.array_sort(F.collect_list(F.struct(fold, "accuracy")))
    return per_fold.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
        ordered["accuracy"].alias("fold_accuracies"),
    )


def _values(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


GRAM = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of columns (both orders and the diagonal), over the rows where both are present.

    Every task folds its rows, batch by batch, into the sums of products of all column pairs; a row
    per task and pair is shuffled. The columns' means (one row, read back) centre the values first, so
    that the sums lose no precision. NULL for a pair with a constant input.
    """
    columns, d = list(columns), len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    means = np.array([m or 0.0 for m in rows.agg(*[F.avg(c) for c in rows.columns]).first()])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(GRAM), d, d))
        for frame in frames:
            values = frame.to_numpy(float) - means
            there = (~np.isnan(values)).astype(float)
            values = np.nan_to_num(values)
            first, second = values.T @ there, (values**2).T @ there
            sums += np.stack([there.T @ there, first, first.T, second, second.T, values.T @ values])
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j} | {name: table[i, j] for name, table in zip(GRAM, sums)})

    schema = "i int, j int, " + ", ".join(f"{name} double" for name in GRAM)
    total = rows.mapInPandas(fold, schema).groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in GRAM])

    def spread(square: str, plain: str) -> Column:
        """n² times the variance; what is left of a constant by rounding counts as 0."""
        left = F.col("n") * F.col(square) - F.col(plain) * F.col(plain)
        return F.when(left > F.lit(1e-13) * F.col("n") * F.col(square), left).otherwise(0.0)

    r = F.try_divide(
        F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
    )
    half = total.select("i", "j", r.alias("r"))
    both = half.unionByName(half.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(F.get(names, F.col("i")).alias("row_name"), F.get(names, F.col("j")).alias("column_name"), "r")


def point_biserial(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of a 0/1 label with each column and its p-value, highest correlation first."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = df.select(F.col(label).cast("double").alias("_y"), F.posexplode(_values(columns)).alias("_i", "_x"))
    per_feature = cells.groupBy("_i").agg(
        correlation("_y", "_x").alias("correlation"), F.count("_x").alias("n")
    )
    return per_feature.select(
        F.get(names, F.col("_i")).alias("feature"), "correlation", correlation_p_value("correlation", "n").alias("p_value")
    ).orderBy(F.desc("correlation"), "feature")


def significant(report: DataFrame, level: float = 0.05) -> DataFrame:
    return report.filter(F.col("p_value") < level)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − mean) / population standard deviation; a constant column is only centred.

    Two numbers per column are read back, as any fitted scaler does.
    """
    fitted = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    scaled = {c: (F.col(c) - F.lit(fitted[f"m_{c}"])) / F.lit(fitted[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)
