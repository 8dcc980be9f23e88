"""Local maxima, minimum-distance thinning, strides and cycles of a series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators.layout import BLOCK, in_blocks, running, with_neighbours
from kinespark.session import stage

LARGEST = 2**22  # positions of the largest block that thinning puts into one task


def local_maxima(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n",
                 height: float | None = None, size: int = BLOCK) -> DataFrame:
    """Positions where the series rises strictly and then falls strictly.

    A flat top counts once, at its middle position rounded down; the first and the last run of a
    series are never maxima. A maximum is found at the row that falls: it exists if the last change
    before that row was a rise. Returns ``keys, pos, value`` of the maxima with ``value >= height``.
    """
    keys = list(keys)
    rows = with_neighbours(df.select(*keys, pos, value), keys, {"_prev": (value, -1)}, pos, size, keep_block=True)
    changed = F.col(value) != F.col("_prev")
    change = F.when(changed, F.struct(F.col(pos).alias("at"), (F.col(value) > F.col("_prev")).alias("rise")))
    rows = running(rows, keys, pos, lasts={"_last": change}, size=size)
    top = rows.filter((F.col(value) < F.col("_prev")) & F.col("_last.rise"))
    peaks = top.select(
        *keys, F.floor((F.col("_last.at") + F.col(pos) - 1) / 2).alias(pos), F.col("_prev").alias(value)
    )
    return peaks if height is None else peaks.filter(F.col(value) >= height)


def walk(height: np.ndarray, at: np.ndarray, kept: np.ndarray, low: int, high: int, d: int) -> np.ndarray:
    """Walk candidates from the highest to the lowest: 1 kept, 0 undecided, -1 dropped.

    ``at`` is sorted. A candidate within ``d`` of a kept one is dropped. One within ``d`` of an undecided one, or
    whose reach leaves the visible range, stays undecided. Each looks at its neighbours within ``d`` only, so the
    time is linear in the candidates.
    """
    first, last = np.searchsorted(at, at - d, "right"), np.searchsorted(at, at + d, "left")
    inside = (at - d >= low) & (at + d <= high)
    state = [None] * len(at)
    for k in np.lexsort((at, height))[::-1].tolist():
        near = state[first[k] : last[k]]
        if kept[k]:
            state[k] = 1
        elif 1 in near:
            state[k] = -1
        else:
            state[k] = 1 if inside[k] and 0 not in near else 0
    return np.array(state, np.int64)


def _decide(size: int, reach: int, d: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What one block (with its halo) says about its own candidates; dropped ones go."""
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        at, block = rows["p"].to_numpy(), int(rows["_block"].iloc[0])
        state = walk(rows["h"].to_numpy(), at, rows["kept"].to_numpy(), block * size - reach, (block + 1) * size + reach, d)
        return rows.assign(kept=state == 1)[(state >= 0) & (at // size == block)].drop(columns="_block")

    return decide


def thin_out(candidates: DataFrame, keys: Sequence[str], distance: float, value: str = "z", pos: str = "n",
             block: int | None = None, halo: int | None = None) -> DataFrame:
    """Keep the highest candidate first and drop every other one closer than ``ceil(distance)``.

    Of equal heights the later one goes first. Each block of positions decides its candidates from
    its own rows and a halo; a candidate whose fate depends on rows beyond the halo stays undecided
    and is settled in the next round, which sees the decisions made so far in larger blocks. The
    highest undecided candidate of a series is always decided, so the rounds end with the exact
    result, and no task ever holds more than one block.
    """
    keys, d = list(keys), math.ceil(distance)
    if d <= 1:
        return candidates
    size, reach = block or max(64 * d, BLOCK), max(halo or 8 * d, d)
    state = candidates.select(*keys, F.col(value).cast("double").alias("h"), F.col(pos).alias("p"), F.lit(False).alias("kept"))
    schema = state.schema
    while True:
        rows, _, _ = in_blocks(state, keys, "p", before=reach, after=reach, size=size)
        state = stage(rows.groupBy(*keys, "_block").applyInPandas(_decide(size, reach, d), schema), "peaks")
        if state.filter(~F.col("kept")).isEmpty():
            break
        size, reach = min(size * 4, max(LARGEST, size)), min(reach * 4, 256 * d)
    return candidates.join(state.select(*keys, F.col("p").alias(pos)), [*keys, pos], "left_semi")


def find_peaks(df: DataFrame, keys: Sequence[str], value: str = "z", pos: str = "n", height: float | None = None,
               distance: float | None = None, keep: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """Local maxima at least ``height`` high, thinned to ``distance`` positions apart.

    Columns in ``keep`` are fetched at the peak positions. Thinned peaks are a stored table at most
    1/``distance`` as long as the series, so the optimizer knows when it can broadcast them.
    """
    peaks = local_maxima(df, keys, value, pos, height, size)
    if distance is not None:
        peaks = thin_out(peaks, keys, distance, value, pos)
    if keep:
        peaks = peaks.join(df.select(*keys, pos, *keep), [*keys, pos])
    return peaks


def strides(peaks: DataFrame, keys: Sequence[str], pos: str = "n", start: Sequence[str] = (),
            size: int = BLOCK) -> DataFrame:
    """One row per pair of consecutive peaks.

    ``stride_no`` counts from 0, ``stride_samples`` is the distance in positions; each column in
    ``start`` is also returned as ``start_<column>`` with its value at the earlier peak.
    """
    carried = F.struct(F.col(pos).alias("_pos"), *start)
    rows = running(peaks, keys, pos, totals={"_count": F.lit(1)}, lasts={"_before": carried}, size=size)
    return rows.filter(F.col("_before").isNotNull()).select(
        *keys,
        (F.col("_count") - 2).alias("stride_no"),
        F.col("_before._pos").alias("start_n"),
        F.col(pos).alias("end_n"),
        (F.col(pos) - F.col("_before._pos")).alias("stride_samples"),
        *[F.col(f"_before.{c}").alias(f"start_{c}") for c in start],
        *[F.col(c).alias(f"end_{c}") for c in start],
    )
