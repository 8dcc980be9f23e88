"""Compare classifiers, keep the report, refit the best one on all rows and store it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators import folds, models, statistics, windows
from kinespark.operators.models import Factory
from kinespark.plans.detection import SUBJECT, defined
from kinespark.session import stage
from kinespark.sources import tables

# Columns of the subject dataset that the two subject classifiers use.
SUBJECT_FEATURES = ["right_z_min", "left_z_min", "right_z_max", "left_z_max"]
SELECTED_FEATURES = [
    "right_z_min", "left_z_iqr", "left_z_min", "left_z_rms", "left_gait_band_energy_mean", "left_z_std", "right_z_max",
    "left_z_max", "right_gait_band_energy_mean", "right_gait_band_energy_std", "right_z_range",
]


@dataclass(frozen=True)
class Trained:
    name: str
    model: PipelineModel
    comparison: DataFrame
    predictions: DataFrame


def _finish(data, columns, label, candidates, comparison, predictions, metric, path, task) -> Trained:
    best = models.best_model(comparison, metric, list(candidates))
    model = models.fit(data, columns, label, candidates[best])
    if path:
        name = models.artefact_name(task, label, best)
        models.save(model, f"{path}/{name}")
        tables.write_csv(comparison.drop("fold_accuracies"), f"{path}/{name}_comparison")
    return Trained(best, model, comparison, predictions)


def train_window_classifier(dataset: DataFrame, columns: Sequence[str], label: str, candidates: dict[str, Factory],
                            keys: Sequence[str] = SUBJECT, n_folds: int = 5, path: str | None = None) -> Trained:
    """Subject-wise folds; the model with the best F1 of class 1 is refitted on all defined windows."""
    usable = defined(dataset, label).na.drop(subset=list(columns))
    data = folds.with_folds(stage(usable, "usable"), keys, n_folds, "window_id")
    predictions = models.cross_validate(data, columns, label, candidates, keep=[*keys, "window_id"])
    comparison = stage(models.compare_models(predictions, label), "comparison")
    return _finish(data, columns, label, candidates, comparison, predictions, "f1", path, "detection")


def train_all_labels(dataset: DataFrame, columns: Sequence[str], candidates: dict[str, Factory], path: str | None = None,
                     n_folds: int = 5, keys: Sequence[str] = SUBJECT) -> dict[str, Trained]:
    """One comparison and one stored model per label rule."""
    return {
        label: train_window_classifier(dataset, columns, label, candidates, keys, n_folds, path)
        for label in windows.LABELS
    }


def train_subject_classifier(dataset: DataFrame, columns: Sequence[str] = SUBJECT_FEATURES, label: str = "label",
                             candidates: dict[str, Factory] | None = None, keys: Sequence[str] = SUBJECT,
                             path: str | None = None) -> Trained:
    """Leave-one-subject-out; the model with the best mean accuracy is refitted on all subjects."""
    candidates = candidates or models.subject_models()
    data = folds.leave_one_out(stage(dataset.select(*keys, label, *columns), "subjects"), keys)
    predictions = models.cross_validate(data, columns, label, candidates, keep=keys)
    comparison = statistics.fold_accuracies(predictions, label=label, by=["model"])
    comparison = stage(comparison.orderBy(F.desc("mean_accuracy"), "model"), "comparison")
    return _finish(data, columns, label, candidates, comparison, predictions, "mean_accuracy", path, "classification")
