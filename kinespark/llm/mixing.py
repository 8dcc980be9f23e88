"""Mixing sources to target weights.

Words are counted per source; every source has a target share of the wished total, at most
``CAP`` times its own size, and what the cap takes away is dealt to the other sources by weight.
rate = target / size; a document is taken floor(rate) times and once more with the probability
of the fraction, drawn from a hash of its id, so reruns agree.

Defined results: a null text has size 0; the null source is a source of its own and comes last;
rows with the same doc_id share their draw, and a null doc_id draws no extra copy; a source without words has
target and copies 0; an empty table gives an empty result. ``emit`` passes all columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import query, table
from kinespark.session import stage

# Fixed values of the mixture.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long"), F.lit(0).cast("long"))


def with_weights(sources: DataFrame) -> DataFrame:
    """Deal the weights to the sources in code point order, null last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("long"))


def with_targets(sources: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Targets of sources (source, source_size, weight), a table of one row per source.

    Resharing until none is above its cap ends at target = least(cap x size, level x weight). The
    sources that end at their cap are the first ones in the order of cap x size / weight, so the
    level follows from running sums in that order: it is the highest one that the next source fits.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    level = (
        share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), zero)
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero))
    capped = sources.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    chosen = capped.withColumn("level", F.max(F.when(fits, F.col("level"))).over(whole))
    return chosen.withColumn(
        "target",
        F.coalesce(F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")),
                   F.lit(0.0)),
    ).drop("level")


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id alone; null without id."""
    text = F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (how often the mixture takes it) of every row."""
    return copies(stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes"))


def copies(sized: DataFrame) -> DataFrame:
    """Add the mixture's columns to rows (doc_id, source, size, ...)."""
    sources = stage(
        with_targets(with_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")))), "targets"
    )
    rates = sources.select(
        F.col("source").alias("source_"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    mixed = sized.join(rates, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    whole = F.floor("rate")
    extra = F.coalesce(draw(F.col("doc_id")) < F.col("rate") - whole, F.lit(False)).cast("long")
    return mixed.withColumn("copies", whole.cast("long") + extra)


def emit(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with its columns unchanged."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    taken = copies(rows).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))
    AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - coalesce(CAST(sum(2 * source_size) OVER before AS BIGINT), 0))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS level FROM w
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(level) AS level FROM l WHERE level * weight <= 2 * source_size),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), f.level * weight) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
  CAST('0x' || substr(md5('mix:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM sized LEFT JOIN r ON sized.source IS NOT DISTINCT FROM r.source
"""


@query("op4_mixing", OP4_SQL)
def op4_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
