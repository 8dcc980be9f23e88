"""Shared helpers: table reading, words, co-located batches of documents and packed key exchange."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.plans.registry import Query
from kinespark.session import stage_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The characters that separate words, and A-Z with their small letters.
SPACES = r"[ \t-\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

BATCH_BYTES = 12_000_000  # stored text of one batch
UNKNOWN_BYTES = 2**50  # estimates from here on are the optimizer's default for unknown sizes


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size, which for a file scan follows from the files.

    Frames that it knows nothing about are measured by their texts.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < UNKNOWN_BYTES:
        return estimate
    return df.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long"))).first()[0]


def batch_count(docs: DataFrame) -> int:
    """How many batches of about BATCH_BYTES to cut the documents into; grows with the input."""
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(docs) // BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Let a Python worker hand freed memory back: it stays for later tasks, and what it keeps counts for its executor.

    To be called at the start of a task's function. Large arrays are mapped one by one from then on, so they go when freed.
    """
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt") and hasattr(library, "malloc_trim"):
        library.mallopt(-3, 2**18)  # -3 names the least size that is mapped
        library.malloc_trim(0)


def batch_of(doc_id: str | Column, batches: int) -> Column:
    return F.pmod(F.hash(doc_id), F.lit(batches))


def stage_bucketed(df: DataFrame, batches: int, name: str = "batches", key: str = "batch") -> DataFrame:
    """Store a frame that is dealt by ``batch`` as a table of one bucket per batch in the shared folder.

    Later passes over whole batches, and co-groups by batch, read the buckets without a shuffle.
    """
    spark, fresh = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    if batches > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(batches))
    (
        df.write.bucketBy(batches, key).option("path", stage_path(spark, name)).option("compression", "zstd")
        .format("parquet").saveAsTable(fresh)
    )
    release(spark)
    return spark.table(fresh)


def stage_batches(docs: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """The columns of all documents, stored by batch (a hash of doc_id), and the number of batches."""
    batches = batch_count(docs)
    chosen = docs.select(*columns, batch_of("doc_id", batches).alias("batch"))
    return stage_bucketed(chosen.repartition(batches, "batch"), batches), batches


# Packed exchange: batches of documents send their 64-bit keys to shards by range of the key, one
# row per (shard, batch); a shard sees every batch's keys of its range and answers each batch.

PACKED = "shard int, batch int, keys binary, marks binary"


def shard_count(batches: int) -> int:
    return max(8, min(batches, 4096))


def pack(batch: int, shards: int, keys: np.ndarray, marks: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of PACKED for one batch; ``marks`` is a value per key and travels with it."""
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]
    width = np.uint64(2**64 // shards + 1)
    cuts = np.searchsorted(keys // width, np.arange(shards + 1, dtype=np.uint64))
    rows = [
        (s, batch, keys[a:b].tobytes(), marks[a:b].tobytes())
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
    ]
    yield pd.DataFrame(rows, columns=["shard", "batch", "keys", "marks"])


def unpack(rows: pd.DataFrame, marks: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys and marks of a shard's rows, and for each the row's number."""
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
    values = [np.frombuffer(m, marks) for m in rows["marks"]]
    owner = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
    return np.concatenate(keys), np.concatenate(values), owner


def join_packed(parts: pd.Series, kind: type) -> np.ndarray:
    """The packed arrays of an answer as one sorted array."""
    found = [np.frombuffer(p, kind) for p in parts if p is not None]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, kind)


def within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values over the whole range."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
