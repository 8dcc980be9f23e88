"""Subject-level and cohort-level tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subject_record(spine: DataFrame, groups: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per subject of ``spine`` with the features of every group; absent ones are NULL."""
    return reduce(lambda left, right: left.join(right, list(keys), "left"), groups, spine)


def cohort_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables, columns matched by name; a column a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missing_sources(expected: DataFrame, scanned: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Expected sources that the scan did not find."""
    return expected.join(scanned.select(*keys).distinct(), list(keys), "left_anti").withColumn("reason", F.lit(reason))


def shape_report(df: DataFrame, name: str) -> DataFrame:
    """Number of rows and columns of a finished table."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def write_with_shape(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write a finished table and report its rows and columns, counted from the footers of its files."""
    df.write.mode("overwrite").parquet(path)
    return shape_report(df.sparkSession.read.schema(df.schema).parquet(path), name)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself, or an error if a key occurs twice."""
    twice = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0].asDict()} is not unique")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that requires the key to be unique on both sides."""
    return require_unique(left, keys).join(require_unique(right, keys), list(keys))
