"""From numbered series to the subject dataset (one row of 56 features per subject)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame

from kinespark.operators import gait, spectra, timedomain
from kinespark.operators.align import complete_rows, merge_sides, sides_long
from kinespark.operators.dataset import subject_record
from kinespark.session import stage


@dataclass(frozen=True)
class FeatureSettings:
    fs: float = 100.0
    window_s: float = 2.0
    stride_height: float = gait.STRIDE_HEIGHT
    stride_distance: float = gait.STRIDE_DISTANCE
    compat: bool = False


def bilateral_series(samples: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Samples of both sides (``side, ts, elapsed, x, y, z``) as one merged, complete, numbered series."""
    left, right = (samples.filter(f"side = '{s}'").drop("side") for s in ("left", "right"))
    return complete_rows(merge_sides(left, right, keys, time), keys)


def long_series(bilateral: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per side of the merged series, with ``n``, ``ts``, ``elapsed`` and ``z``."""
    return sides_long(bilateral, keys, ["elapsed", "z"])


def subject_features(series: DataFrame, spine: DataFrame, keys: Sequence[str],
                     settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """All four feature groups joined to the subjects of ``spine`` (keys and label).

    ``series`` has ``side, n, ts, elapsed, z`` and is read once per group, so pass a stored table.
    """
    keys = list(keys)
    by = [*keys, "side"]

    def statistics():
        return timedomain.time_domain_wide(timedomain.time_domain(series, by, compat=settings.compat), keys)

    def spectrum():
        found = spectra.spectral_windows(series, by, keys, fs=settings.fs, width_s=settings.window_s)
        return spectra.summarize_spectra(found, keys)

    def symmetry():
        found = stage(gait.stride_times(series, keys, settings.stride_height, settings.stride_distance), "strides")
        return gait.summarize_symmetry(gait.stride_symmetry(found, keys), keys)

    def limbs():
        return gait.mean_and_std(gait.cross_limb(series, keys, settings.fs), keys, exclude=["cycle_no"])

    # the groups are independent: their stored intermediates are written side by side
    with ThreadPool(4) as pool:
        groups = pool.map(lambda group: group(), [statistics, spectrum, symmetry, limbs])
    return subject_record(spine, groups, keys)
