"""Byte files in the shared folder, written and range-read inside tasks.

Spark has no sink for raw bytes, so archives and token files go through pyarrow's file systems,
which know local, object-store and HDFS addresses. A file's name is fresh for every attempt of a
task; only the names that a finished task returns are ever read, so a lost executor or a repeated
attempt leaves nothing but a file that nobody refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from kinespark.session import stage_path


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder as an address that pyarrow can resolve."""
    path = stage_path(spark, name)
    return path if "://" in path or path.startswith("/") else path.replace("file:", "", 1)


def fresh(path: str, suffix: str) -> str:
    return f"{path}/{uuid.uuid4().hex}{suffix}"


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_new(path: str):
    where, inner = resolve(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    return where.open_output_stream(inner, compression=None)


def open_ranges(path: str):
    where, inner = resolve(path)
    return where.open_input_file(inner)
