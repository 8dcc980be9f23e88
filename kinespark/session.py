"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Timestamps are zone-free, so the session zone must not shift them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "kinespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinespark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/kinespark/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> bool:
    """Delete what this application has staged, once its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a scan of it.

    Cuts the lineage (a lost executor re-reads files instead of re-running the plan), keeps column
    pruning and push-down for the readers, and gives the optimizer the table's true size, so a
    later join broadcasts it only when it is measured to be small.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
