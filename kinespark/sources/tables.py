"""Stored tables, tensors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the Parquet table at ``path``."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tensors(windows: DataFrame, path: str, partition_by: tuple[str, ...] = ("cohort",)) -> None:
    """Raw windows: one row per window with ``x`` (array of samples of channels), labels and ids."""
    write_table(windows, path, partition_by)


def read_tensors(spark: SparkSession, path: str, defined_by: str | None = None) -> DataFrame:
    """Stored windows; ``defined_by`` names a label whose undefined value (2) is filtered out at the scan."""
    stored = read_table(spark, path)
    return stored if defined_by is None else stored.filter(F.col(defined_by) != 2)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the CSV table at ``path``; no index column, header in every part."""
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
