"""How a recording is spread over the cluster.

A recording ("series") is a set of rows with the same key columns, ordered by time. One recording
may hold a large share of all rows, so no operator here puts a whole series into one task:

* :func:`enumerate_rows` gives every row its dense position in the series;
* :func:`in_blocks` cuts a series into blocks of positions, each with the neighbouring rows
  ("halo") that an operator needs to see;
* :func:`running` computes running totals and last-seen values in two levels: inside each block,
  and over one summary row per block;
* :func:`attach` brings one-row-per-series values back to the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.session import stage

BLOCK = 65_536  # rows of one series that one task orders at a time
SERIES_LIMIT = 2_000_000  # a longer series is ordered by range partitions instead of by key
BROADCAST_ROWS = 500_000  # per-series tables up to this many rows are broadcast,
BROADCAST_BYTES = 32 * 2**20  # if their files are not larger than this
SALTS = 64


def longest_series(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the longest series (one aggregation over the key columns only)."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def split_long(df: DataFrame, keys: Sequence[str], limit: int, longest: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series with at most ``limit`` rows, and the rows of longer ones (None if there are none).

    ``longest`` is the size of the longest series, if it is known. The long series are at most
    rows / limit many; their stored list is broadcast as far as its size permits.
    """
    keys = list(keys)
    if (longest_series(df, keys) if longest is None else longest) <= limit:
        return df, None
    long = stage(df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys), "long-series")
    return df.join(long, keys, "left_anti"), df.join(long, keys, "left_semi")


def enumerate_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "n",
    limit: int = SERIES_LIMIT,
    ranges: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series; ``order`` must be unique in a series.

    Series of ordinary length are numbered by a window. The rows of series longer than ``limit``
    are range-partitioned by (keys, order) instead, which splits a hot series over many tasks; the
    position is then the row's index in its range plus the rows that earlier ranges hold of the
    same series (one row per series and range). The number of ``ranges`` is the session's number of
    shuffle partitions, less those that adaptive execution finds too small.
    """
    keys, order = list(keys), list(order)
    ordinary, long = split_long(df, keys, limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = ordinary.withColumn(name, F.row_number().over(w).cast("long") - 1)
    return numbered if long is None else numbered.unionByName(_enumerate_by_ranges(long, keys, order, name, ranges))


def _enumerate_by_ranges(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None) -> DataFrame:
    row_mask = (1 << 33) - 1
    ranged = stage(
        df.repartitionByRange(*([ranges] if ranges else []), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(row_mask))),
        "ranges",
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range", *keys)
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
        .select("_range", *keys, "_shift")
    )
    # the staged table's size is known, so it is broadcast only if small; otherwise the join
    # shuffles by (range, keys), and no such group is larger than one range
    return (
        ranged.join(stage(starts, "starts"), ["_range", *keys])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_range", "_row", "_shift")
    )


def stored_bytes(table: DataFrame) -> int:
    """Size of a stored table's files, as the optimizer sees it."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], spread: str = "n",
           bound: int = BROADCAST_ROWS, how: str = "inner", stored: bool = False) -> DataFrame:
    """Join one-row-per-series values onto the rows of the series.

    The table is written first and broadcast if it has at most ``bound`` rows in at most BROADCAST_BYTES
    of files. Beyond that it is repeated once per salt and joined on (keys, salt), so that a hot series is
    spread over ``SALTS`` tasks. ``spread`` is a column of ``df`` that varies inside a series. ``stored`` says
    that the table has been written already.
    """
    keys = list(keys)
    table = table if stored else stage(table, "series")
    if table.count() <= bound and stored_bytes(table) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), keys, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(table.withColumn("_salt", salts), [*keys, "_salt"], how)
        .drop("_salt")
    )


def block_of(pos: str | Column, size: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size))


def in_blocks(df: DataFrame, keys: Sequence[str], pos: str = "n", before: int = 0, after: int = 0,
              size: int = BLOCK) -> tuple[DataFrame, Window, Column]:
    """Copy each row into every block that must see it.

    Block ``b`` holds the positions ``[b*size - before, (b+1)*size + after)``. Returns the rows with
    a ``_block`` column, the window that orders one block, and the condition that a row belongs to
    the block proper rather than to its halo.
    """
    n = F.col(pos)
    if before == 0 and after == 0:
        out = df.withColumn("_block", block_of(n, size))
    else:
        first = F.greatest(F.lit(0), block_of(n - after, size))
        out = df.withColumn("_block", F.explode(F.sequence(first, block_of(n + before, size))))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    return out, w, block_of(n, size) == F.col("_block")


def with_neighbours(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str | Column, int]],
                    pos: str = "n", size: int = BLOCK, keep_block: bool = False) -> DataFrame:
    """Add values of nearby rows: ``{alias: (column, offset)}``, offset < 0 is earlier.

    ``keep_block`` leaves the ``_block`` column in, so that :func:`running` can go on in the same
    partitions.
    """
    offsets = [offset for _, offset in wanted.values()]
    rows, w, own = in_blocks(df, keys, pos, before=max(0, -min(offsets)), after=max(0, max(offsets)), size=size)
    rows = rows.select(
        "*", *[(F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w).alias(alias) for alias, (c, k) in wanted.items()]
    )
    rows = rows.filter(own)
    return rows if keep_block else rows.drop("_block")


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "n",
    totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    order: Sequence[str] = (),
    size: int = BLOCK,
) -> DataFrame:
    """Running sums up to and including the row (``totals``) and the last non-null value of
    strictly earlier rows (``lasts``); ``order`` breaks ties of ``pos``.

    Two levels: a window inside each block of ``size`` positions, and a window over one summary row
    per block whose result is carried into the block. A ``_block`` column left by
    :func:`with_neighbours` is used as it is.
    """
    totals, lasts = dict(totals or {}), dict(lasts or {})
    keys = list(keys)
    columns = [c for c in df.columns if c != "_block"]
    rows = df if "_block" in df.columns else in_blocks(df, keys, pos, size=size)[0]
    w = Window.partitionBy(*keys, "_block").orderBy(pos, *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[c.alias(f"_v_{a}") for a, c in {**totals, **lasts}.items()])
    summary = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{a}").alias(f"_c_{a}") for a in totals],
        *[F.max_by(f"_v_{a}", F.when(F.col(f"_v_{a}").isNotNull(), F.col(pos))).alias(f"_c_{a}") for a in lasts],
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_c_{a}").over(over_blocks), F.lit(0)).alias(f"_k_{a}") for a in totals],
        *[F.last(f"_c_{a}", ignorenulls=True).over(over_blocks).alias(f"_k_{a}") for a in lasts],
    )
    scanned = rows.select(
        *columns,
        "_block",
        *[F.coalesce(F.sum(f"_v_{a}").over(upto), F.lit(0)).alias(f"_i_{a}") for a in totals],
        *[F.last(f"_v_{a}", ignorenulls=True).over(before).alias(f"_i_{a}") for a in lasts],
    )
    # the same (keys, block) partitioning serves the windows and this join
    return scanned.join(carry, [*keys, "_block"]).select(
        *columns,
        *[(F.col(f"_i_{a}") + F.col(f"_k_{a}")).alias(a) for a in totals],
        *[F.coalesce(f"_i_{a}", f"_k_{a}").alias(a) for a in lasts],
    )
