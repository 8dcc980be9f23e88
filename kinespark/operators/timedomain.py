"""Whole-recording statistics of one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.scalar import mixed_kurtosis, mixed_skewness
from kinespark.operators.layout import attach, enumerate_rows, longest_series, split_long, with_neighbours
from kinespark.session import stage

QUANTILE_LIMIT = 500_000  # a larger group is ranked across the cluster

SKETCH = 2_000  # size of a quantile sketch

STATISTICS = ("mean", "std", "max", "min", "rms", "mad", "range", "iqr", "skew", "kurt", "zcr", "pkcnt", "pkamp")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
              tiebreak: str = "n", limit: int = QUANTILE_LIMIT, longest: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probabilities``.

    ``percentile`` combines equal values before the shuffle but keeps a group's distinct values in
    one task's memory, so it serves groups of at most ``limit`` rows. The rows of larger groups are
    ranked across the whole cluster and the (at most two) rows at each requested place are picked.
    ``longest`` is the size of the largest group, if it is known.
    """
    keys = list(keys)
    rows = df.select(*keys, value, tiebreak).filter(F.col(value).isNotNull())
    ordinary, long = split_long(rows, keys, limit, longest)
    # one call for all probabilities: each call would keep its own map
    wanted = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    found = ordinary.groupBy(*keys).agg(F.percentile(value, wanted).alias("_q")).select(
        *keys, *[F.get("_q", F.lit(i)).alias(a) for i, a in enumerate(probabilities)]
    )
    return found if long is None else found.unionByName(_quantiles_by_rank(long, keys, value, probabilities, tiebreak))


def _quantiles_by_rank(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], tiebreak: str) -> DataFrame:
    ranked = enumerate_rows(rows, keys, [value, tiebreak], name="_rank", limit=0)
    counts = ranked.groupBy(*keys).agg(F.count("*").alias("_rows"))
    ranked = attach(ranked, counts, keys, "_rank")
    picked = []
    for alias, p in probabilities.items():
        place = (F.col("_rows") - 1) * F.lit(p)
        low, share = F.floor(place), place - F.floor(place)
        weight = F.when(F.col("_rank") == low, 1 - share).when(F.col("_rank") == low + 1, share)
        picked.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(alias))
    return ranked.groupBy(*keys).agg(*picked)


def rank_error(k: int) -> float:
    """How far the rank of a sketched quantile may be off, as a share of the rows (99% confidence)."""
    return 2.296 / k**0.9723


def sketched_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], k: int = SKETCH) -> DataFrame:
    """Quantiles from mergeable sketches of about 3 ``k`` values, one column per entry of ``probabilities``.

    Every task sketches its rows and Spark merges the sketches, so a hot group costs its tasks a few kilobytes each
    and is neither sorted nor kept. A result is a value of the group whose rank is within :func:`rank_error` of the
    wanted one; there is no interpolation.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("_sketch")
    )
    return rows.select(*keys, *[
        F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(alias) for alias, p in probabilities.items()
    ])


def time_domain(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n", compat: bool = False,
                limit: int = QUANTILE_LIMIT, sketch: int | None = None) -> DataFrame:
    """Thirteen statistics of ``value`` per series.

    Zero crossings are counted between neighbouring rows of opposite sign. ``compat`` reports them
    as 0, which is what multiplying index-aligned columns yields. With ``sketch`` the median, the quartiles and the median
    deviation come from sketches of that size (:func:`sketched_quantiles`) in place of exact ranks.
    """
    keys = list(keys)
    rows = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    longest = None if sketch else longest_series(rows, keys)

    def ranks(of: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
        return sketched_quantiles(of, keys, column, wanted, sketch) if sketch else quantiles(of, keys, column, wanted, pos, limit, longest)

    middle = stage(ranks(rows, value, {"_median": 0.5, "_q1": 0.25, "_q3": 0.75}), "middle")
    deviations = attach(rows, middle.select(*keys, "_median"), keys, pos, stored=True).select(
        *keys, pos, F.abs(F.col(value) - F.col("_median")).alias("_dev")
    )
    mad = ranks(deviations, "_dev", {"mad": 0.5})
    z = F.col(value)
    crossings = F.lit(0).cast("long") if compat else F.count_if(z * F.col("_next") < 0)
    stats = with_neighbours(rows, keys, {"_next": (value, 1)}, pos).groupBy(*keys).agg(
        F.avg(z).alias("mean"),
        F.stddev_samp(z).alias("std"),
        F.max(z).alias("max"),
        F.min(z).alias("min"),
        F.sqrt(F.avg(z * z)).alias("rms"),
        mixed_skewness(z).alias("skew"),
        mixed_kurtosis(z).alias("kurt"),
        crossings.alias("zcr"),
    )
    # three tables of one row per series
    return stats.join(middle, keys).join(mad, keys).select(
        *keys, "mean", "std", "max", "min", "rms", "mad",
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("_q3") - F.col("_q1")).alias("iqr"),
        "skew", "kurt", "zcr",
        F.col("zcr").alias("pkcnt"),
        (F.col("max") - F.col("min")).alias("pkamp"),
    )


def time_domain_wide(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per subject with ``{side}_z_{statistic}`` columns (26)."""
    return stats.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(s))).alias(f"{side}_z_{s}")
            for side in ("left", "right")
            for s in STATISTICS
        ]
    )


def extremes(df: DataFrame, keys: Sequence[str], value: str = "z") -> DataFrame:
    """Right and left minimum, right and left maximum: the four inputs of the subject classifier."""
    def of(side):
        return F.when(F.col("side") == side, F.col(value))

    return df.groupBy(*keys).agg(
        F.min(of("right")).alias("right_z_min"), F.min(of("left")).alias("left_z_min"),
        F.max(of("right")).alias("right_z_max"), F.max(of("left")).alias("left_z_max"),
    )
