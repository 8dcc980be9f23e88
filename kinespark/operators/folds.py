"""Splits that keep a subject's rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators.layout import SERIES_LIMIT, attach, enumerate_rows
from kinespark.session import stage


def walk(load: list[int], size: int, groups: int) -> list[tuple[int, int, list[int]]]:
    """Where equally large groups go, one after the other, each to the fold with the fewest rows (the first of equals).

    ``(start, end, cycle)``: places from start to end take the folds of the cycle in turn. ``load`` is updated.
    The folds that lie within one group of the emptiest take turns until they reach the next fold, so there are
    at most as many pieces as folds, however many groups.
    """
    out, start = [], 0
    while start < groups:
        order = sorted(range(len(load)), key=lambda f: (load[f], f))
        low = load[order[0]]
        cycle = [f for f in order if (load[f], f) < (low + size, order[0])]
        left = groups - start
        if len(cycle) < len(order):
            other = order[len(cycle)]
            rounds, rest = divmod(load[other] - low, size)
            left = min(left, (rounds - (rest == 0 and other < order[0])) * len(cycle))
        for k, f in enumerate(cycle):
            load[f] += size * (left // len(cycle) + (k < left % len(cycle)))
        out.append((start, start + left, cycle))
        start += left
    return out


def group_folds(df: DataFrame, keys: Sequence[str], folds: int = 5, limit: int = SERIES_LIMIT) -> DataFrame:
    """``keys, fold`` per group: the largest group goes to the fold with the fewest rows so far, equal ones in key order.

    That walk is sequential, but groups of one size need only its pieces (:func:`walk`). So the driver walks over the
    distinct sizes, of which n rows have at most sqrt(2n), and each group looks up its rank among the groups of its size.
    More than ``limit`` groups of one size are ranked by ranges.
    """
    keys = list(keys)
    sizes = stage(df.groupBy(*keys).agg(F.count("*").alias("_size")), "groups")
    histogram = sizes.groupBy("_size").agg(F.count("*").alias("_groups")).orderBy(F.desc("_size")).collect()
    if sum(r["_groups"] for r in histogram) < folds:
        raise ValueError(f"{folds} folds need at least as many groups")
    load = [0] * folds
    pieces = df.sparkSession.createDataFrame(
        [(r["_size"], walk(load, r["_size"], r["_groups"])) for r in histogram],
        "_size long, _pieces array<struct<start:long,end:long,cycle:array<int>>>",
    )
    ranked = enumerate_rows(sizes, ["_size"], keys, name="_place", limit=limit)
    placed = attach(ranked, pieces, ["_size"], "_place")
    piece = F.filter("_pieces", lambda x: (F.col("_place") >= x["start"]) & (F.col("_place") < x["end"]))[0]
    turn = (F.col("_place") - F.col("_piece.start")) % F.size("_piece.cycle")
    fold = F.get("_piece.cycle", turn.cast("int"))
    return placed.withColumn("_piece", piece).select(*keys, fold.alias("fold"))


def with_folds(df: DataFrame, keys: Sequence[str], folds: int = 5, spread: str | None = None) -> DataFrame:
    """Add the ``fold`` of each row's group."""
    return attach(df, group_folds(df, keys, folds), keys, spread or next(c for c in df.columns if c not in keys))


def leave_one_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One fold per group, numbered in key order; every fold is one model fit."""
    keys = list(keys)
    groups = df.select(*keys).distinct().withColumn("_one", F.lit(0))
    numbered = enumerate_rows(groups, ["_one"], keys, name="fold").select(*keys, F.col("fold").cast("int").alias("fold"))
    return attach(df, numbered, keys, next(c for c in df.columns if c not in keys))


def holdout(df: DataFrame, keys: Sequence[str], share: float = 0.75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: repeatable in any engine, and a key is never in both."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000
    return df.filter(place < round(share * 10_000)), df.filter(place >= round(share * 10_000))
