"""Token counts by a separator scan of flat, unindexed token files.

``write`` encodes documents and appends their ids, each followed by the end-of-document id, to
flat files of little-endian 16-bit numbers (32-bit ones where the vocabulary needs them). ``scan``
knows nothing but the files' names and sizes: it cuts them into blocks of fixed size, finds the
separators of a block with one vectorised comparison, and stitches the documents that cross block
borders with a prefix scan over one summary row per block: the last separator before the block
tells where its first document began, wherever that was.

Defined results: a null or empty text has 0 tokens and still its separator; texts that spell the
separator's name are ordinary text; an empty table writes no file and gives an empty result.
Repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm import flat_files
from kinespark.llm.common import query, table
from kinespark.session import stage

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 4 * 2**20
TEXT_BATCH = 1_000_000  # characters that are encoded at a time

MANIFEST = "file string, position long, doc_id string, file_bytes long, width int"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def separator_id(ranks: str = RANKS) -> tuple[int, int]:
    """The separator's id, which is the first one free, and the bytes an id takes."""
    separator = max(load_ranks(ranks).values()) + 1
    return separator, 2 if separator < 2**16 else 4


def batches_of(texts: pd.Series, limit: int = TEXT_BATCH) -> Iterator[list[str]]:
    """Texts in lists of about ``limit`` characters; null counts as empty."""
    some: list[str] = []
    held = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        some.append(text)
        held += len(text)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def write(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Write one flat file per task; the manifest tells which document is the n-th of a file."""
    path = flat_files.folder(docs.sparkSession, "tokens")
    separator, width = separator_id(ranks)
    known = load_ranks(ranks)  # travels with the tasks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        kind, ids = np.dtype(f"<u{width}"), []
        name = flat_files.fresh(path, ".bin")
        out = None
        for frame in frames:
            if out is None:
                out = flat_files.open_new(name)
            for some in batches_of(frame["text"]):
                found: list[int] = []
                for text in some:
                    found += encoder.encode_ordinary(text)
                    found.append(separator)
                out.write(np.asarray(found, kind).tobytes())
            ids.append(frame["doc_id"])
        if out is not None:
            size = out.tell()
            out.close()
            listed = pd.concat(ids, ignore_index=True)
            yield pd.DataFrame({
                "file": name, "position": np.arange(len(listed)), "doc_id": listed, "file_bytes": size, "width": width,
            })

    # ids go through pandas as text, which keeps their digits beside nulls
    listed = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, MANIFEST)
    return stage(listed.withColumn("doc_id", F.col("doc_id").cast("long")), "manifest")


BLOCK = "file string, block long, first_gap long, last_gap long, separators long, inner binary"


def scan(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, position, n_tokens) of every document in files (file, file_bytes, width)."""
    last = F.floor((F.col("file_bytes") - 1) / block_bytes).cast("long")
    jobs = files.filter("file_bytes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    spread = max(files.sparkSession.sparkContext.defaultParallelism,
                 int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                with flat_files.open_ranges(row.file) as data:
                    start = row.block * block_bytes
                    ids = np.frombuffer(data.read_at(min(block_bytes, row.file_bytes - start), start), f"<u{row.width}")
                at = np.flatnonzero(ids == separator)
                base = start // row.width
                yield pd.DataFrame({
                    "file": [row.file], "block": [row.block],
                    # positions in the file, in tokens; -1 without a separator
                    "first_gap": [base + at[0] if len(at) else -1], "last_gap": [base + at[-1] if len(at) else -1],
                    "separators": [len(at)], "inner": [(np.diff(at) - 1).astype("<i8").tobytes()],
                })

    blocks = stage(jobs.repartition(spread, "file", "block").mapInPandas(find, BLOCK), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.withColumns({
        "started": F.coalesce(F.max("last_gap").over(before), F.lit(-1).cast("long")),
        "earlier": F.coalesce(F.sum("separators").over(before), F.lit(0).cast("long")),
    }).filter("separators > 0")

    def lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                counts = np.concatenate([[row.first_gap - row.started - 1], np.frombuffer(row.inner, "<i8")])
                yield pd.DataFrame({
                    "file": row.file, "position": row.earlier + np.arange(len(counts)), "n_tokens": counts,
                })

    return stitched.mapInPandas(lengths, "file string, position long, n_tokens long")


def count_tokens(docs: DataFrame, ranks: str = RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens of every row: written to flat files and counted from the files alone."""
    manifest = write(docs, ranks)
    files = manifest.groupBy("file").agg(F.first("file_bytes").alias("file_bytes"), F.first("width").alias("width"))
    counted = scan(files, separator_id(ranks)[0], block_bytes)
    return manifest.join(counted, ["file", "position"], "left").select("doc_id", "n_tokens")


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
