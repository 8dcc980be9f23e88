"""Exact dedup with a sharded cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its lower-cased (A-Z only) UTF-8 bytes. Digests are dealt to
shards by their first bytes; a shard's index holds a cuckoo filter of short fingerprints and, per
filter bucket, the stored keys (whole digest, length, keeper). A fingerprint that the filter does
not know is new; a hit is verified against the stored keys of its two buckets. Keys can be
deleted, and a filter that overflows is rebuilt at twice the size from the stored keys.

Each task folds the copies of an Arrow batch before the shuffle, so thousands of them reach a shard as a few
rows; the index finds, verifies and merges those, and is stored (one row per live digest) for later batches.

Defined results: a null text counts as empty; all empty texts are equal; of equal texts the
largest doc_id stays, null being the smallest, and of repeated rows with that doc_id all count as kept (they are
the same row; ``keep_first`` returns one of them); rows with one doc_id and different texts are judged each; an
empty table gives an empty result; columns with clashing names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import LOWER, UPPER, give_back, query, table
from kinespark.session import stage

KEYS_PER_SHARD = 50_000  # aimed at; a shard with more keys grows its filter
SHARDS = 8  # of a small index; an index keeps its number of shards


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over stored keys; supports insert, find and delete."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 64):
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, self.SLOTS), np.uint16)
        self.content: dict[int, dict[bytes, tuple]] = {}
        self.count = 0

    def _print(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:18], "little") & self.mask

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & self.mask)

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says: False is certain."""
        p, b = self._print(digest), self._home(digest)
        return p in self.slots[b].tolist() or p in self.slots[self._other(b, p)].tolist()

    def find(self, digest: bytes) -> tuple | None:
        """The value stored for the digest; filter hits are verified against the bucket's whole keys."""
        return self.content.get(self._home(digest), {}).get(digest) if self.maybe(digest) else None

    def insert(self, digest: bytes, value: tuple) -> None:
        """Add a key, or replace the value of a live one."""
        if self.find(digest) is None:
            while not self._place(digest):
                self._grow()
            self.count += 1
        self.content.setdefault(self._home(digest), {})[digest] = value

    def _place(self, digest: bytes) -> bool:
        print_, bucket = self._print(digest), self._home(digest)
        moves = []
        for kick in range(self.KICKS):
            for b in (bucket, self._other(bucket, print_)):
                free = np.flatnonzero(self.slots[b] == 0)
                if len(free):
                    self.slots[b, free[0]] = print_
                    return True
            bucket = self._other(bucket, print_) if kick % 2 else bucket
            slot = (print_ + kick) % self.SLOTS
            moves.append((bucket, slot, int(self.slots[bucket, slot])))
            print_, self.slots[bucket, slot] = int(self.slots[bucket, slot]), print_
            bucket = self._other(bucket, print_)
        for bucket, slot, old in reversed(moves):
            self.slots[bucket, slot] = old
        return False

    def _grow(self) -> None:
        keys = list(self.items())
        size = 2 * (self.mask + 1)
        while True:
            self._clear(size)
            if all(self._place(d) for d, _ in keys):
                break
            size *= 2
        for digest, value in keys:
            self.content.setdefault(self._home(digest), {})[digest] = value
        self.count = len(keys)

    def delete(self, digest: bytes) -> bool:
        """Remove a live key; False if it is not stored."""
        if self.find(digest) is None:
            return False
        del self.content[self._home(digest)][digest]
        p, b = self._print(digest), self._home(digest)
        for bucket in (b, self._other(b, p)):
            at = np.flatnonzero(self.slots[bucket] == p)
            if len(at):
                self.slots[bucket, at[0]] = 0
                break
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self.content.values():
            yield from bucket.items()


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of every row."""
    return docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))


INDEX = "shard int, digest binary, keep_id long, group_size long"


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _as_text(rows: DataFrame) -> DataFrame:
    """Ids as text: pandas turns numbers beside nulls to floats."""
    return rows.withColumn("keep_id", F.col("keep_id").cast("string"))


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _listed(live: CuckooIndex, pdf: pd.DataFrame) -> pd.DataFrame:
    found = list(live.items())
    return pd.DataFrame({
        "shard": pd.Series([int(pdf["shard"].iloc[0])] * len(found), dtype="int32"), "digest": [d for d, _ in found],
        "keep_id": pd.array([k for _, (k, _) in found], dtype="Int64"),
        "group_size": pd.Series([n for _, (_, n) in found], dtype="int64"),
    })


def build(counted: DataFrame, index: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Insert (text_sha256, keep_id, group_size) rows, with several rows per digest, into a stored index.

    ``index`` has the columns of INDEX; without it a new one starts. ``group_size`` below 0 takes
    copies away, and a digest with none left is deleted; then keep_id is the caller's to restate.
    """
    new = counted.select(
        F.lit(None).cast("int").alias("shard"), F.unhex("text_sha256").alias("digest"), "keep_id", "group_size"
    ).withColumn("shard", _shard(F.hex("digest"), shards))
    rows = new if index is None else index.select("shard", "digest", "keep_id", "group_size").unionByName(new)
    rows = _as_text(rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex(len(pdf) // 2 + 2)
        for digest, keep, size in zip(pdf["digest"], map(_number, pdf["keep_id"]), pdf["group_size"]):
            old = live.find(digest)
            if old is None:
                live.insert(digest, (keep, size))
                continue
            total = old[1] + size
            best = max((k for k in (old[0], keep) if k is not None), default=None)
            if total <= 0:
                live.delete(digest)
            else:
                live.insert(digest, (best, total))
        return _listed(live, pdf)

    return rows.groupBy("shard").applyInPandas(run, INDEX)


def remove(index: DataFrame, gone: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Delete the digests of ``gone`` (text_sha256) from a stored index of so many shards, whatever their group sizes."""
    marks = gone.select(F.unhex("text_sha256").alias("digest")).distinct().withColumn("gone", F.lit(True))
    marked = index.select("shard", "digest", "keep_id", "group_size", F.lit(False).alias("gone")).unionByName(
        marks.select(
            _shard(F.hex("digest"), shards).alias("shard"), "digest", F.lit(None).cast("long").alias("keep_id"),
            F.lit(0).cast("long").alias("group_size"), "gone",
        )
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex(len(pdf) // 2 + 2)
        for row in pdf[~pdf["gone"]].itertuples():
            live.insert(row.digest, (_number(row.keep_id), row.group_size))
        for digest in pdf.loc[pdf["gone"], "digest"]:
            live.delete(digest)
        return _listed(live, pdf)

    return _as_text(marked).groupBy("shard").applyInPandas(run, INDEX)


def pre_aggregate(hashed: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) per digest of each Arrow batch: folded inside the task, without a shuffle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            folded = pa.Table.from_batches([batch]).group_by("text_sha256", use_threads=False).aggregate(
                [("doc_id", "max"), ([], "count_all")]
            )
            yield from folded.select(["text_sha256", "doc_id_max", "count_all"]).rename_columns(
                ["text_sha256", "keep_id", "group_size"]
            ).combine_chunks().to_batches()

    return hashed.select("text_sha256", F.col("doc_id").cast("long")).mapInArrow(
        fold, "text_sha256 string, keep_id long, group_size long"
    )


def groups_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha256) of every row, stored, and the index over all rows."""
    hashed = stage(digests(docs), "digests")
    counted = pre_aggregate(hashed)
    return hashed, stage(build(counted, shards=max(SHARDS, hashed.count() // KEYS_PER_SHARD)), "index")


def label(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    hashed, index = groups_of(docs)
    live = index.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")
    copied = live.filter("group_size > 1")
    alone = F.lit(1).cast("long")
    return hashed.join(copied, "text_sha256", "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", alone).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: one per text, that with the largest doc_id.

    Only the ids and digests of dropped rows are joined, so the texts of most documents are filtered in place.
    """
    marked = label(docs)
    gone = marked.filter(~F.col("kept")).select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                      F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    stays = row.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left_anti")
    again = marked.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    again = stage(again.select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_")), "repeated")
    if again.isEmpty():
        return stays.select("row.*")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_"))
    one = stays.join(again, same, "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row"))
    return stays.join(again, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark, sf_dir):
    return label(table(spark, sf_dir, "documents").select("doc_id", "text"))
