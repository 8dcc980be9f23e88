"""Score recordings and windows with stored models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.scalar import mean_or_zero
from kinespark.operators import gait, models, timedomain, windows
from kinespark.session import stage

LIVE_HEIGHT, LIVE_DISTANCE = 10, 30


def score_recordings(series: DataFrame, keys: Sequence[str], model: PipelineModel) -> DataFrame:
    """Class and probability per recording from its four extremes."""
    return models.score(model, timedomain.extremes(series, keys))


def stride_measures(series: DataFrame, keys: Sequence[str], height: float = LIVE_HEIGHT,
                    distance: float = LIVE_DISTANCE) -> DataFrame:
    """Mean asymmetry index and symmetry ratio per recording, 0 without a pair of strides."""
    found = stage(gait.stride_times(series, keys, height, distance), "strides")
    pairs = gait.stride_symmetry(found, keys)
    every = series.select(*keys).distinct()
    asymmetry, symmetry = windows.ASYMMETRY_FEATURES
    return every.join(pairs, list(keys), "left").groupBy(*keys).agg(
        mean_or_zero("asymmetry_index").alias(asymmetry), mean_or_zero("symmetry_ratio").alias(symmetry)
    )


def score_strides(series: DataFrame, keys: Sequence[str], model: PipelineModel, **peaks: float) -> DataFrame:
    """Symmetric or asymmetric per recording, from its stride measures."""
    scored = models.score(model, stride_measures(series, keys, **peaks))
    return scored.withColumn("state", F.when(F.col("prediction") == 1, "ASYMMETRIC").otherwise("SYMMETRIC"))
