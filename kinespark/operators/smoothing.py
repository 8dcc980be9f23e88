"""Low-pass filtering of whole series, block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.lowpass import PAD, impulse_response, smooth_udf
from kinespark.operators.layout import in_blocks

FILTER_BLOCK = 8_192


def low_pass(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n", cutoff: float = 6.0,
             fs: float = 100.0, name: str = "z_filtered", keep: Sequence[str] = (),
             size: int = FILTER_BLOCK) -> DataFrame:
    """Zero-phase Butterworth low-pass of order 2.

    Each block is collected with a halo as long as the impulse response (which decays below double
    precision), filtered in Arrow batches, and exploded back to rows. Series of ``PAD`` rows or
    fewer cannot be padded and are left out; :func:`too_short` lists them. Returns ``keys, pos,
    value, *keep, name``.
    """
    keys = list(keys)
    taps = len(impulse_response(cutoff, fs))
    halo = taps + PAD
    columns = [pos, value, *keep]
    rows, _, _ = in_blocks(df.select(*keys, *columns), keys, pos, before=halo, after=halo, size=size)
    blocks = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    start = F.col("_block") * size
    first, last = F.element_at("_rows", 1)[pos], F.element_at("_rows", -1)[pos]
    at_start = first == 0
    at_end = last < start + size + halo - 1
    # a block with no row of its own exists only as the echo of a neighbour's halo
    has_own = (last >= start) & (first < start + size)
    long_enough = ~(at_start & at_end) | (F.size("_rows") > PAD)
    return (
        blocks.filter(has_own & long_enough)
        .withColumn("_y", smooth_udf(cutoff, fs)(F.col(f"_rows.{value}"), at_start, at_end))
        .select(*keys, "_block", F.inline(F.arrays_zip("_rows", F.col("_y").alias("_y"))))
        .filter(F.floor(F.col(f"_rows.{pos}") / size) == F.col("_block"))
        .select(*keys, *[f"_rows.{c}" for c in columns], F.col("_y").alias(name))
    )


def too_short(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series that :func:`low_pass` rejects."""
    return df.groupBy(*keys).count().filter(F.col("count") <= PAD).select(
        *keys, F.lit("too short to filter").alias("reason")
    )
