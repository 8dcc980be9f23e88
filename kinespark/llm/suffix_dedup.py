"""Removal of repeated 200-byte strings by prefix doubling over the suffixes of all texts.

Doubling gives every position a rank for a short prefix, then for longer ones from pairs of ranks
at growing offsets, and drops positions whose rank is unique. Here ranks are 64-bit hashes, so the
ranks of equal prefixes are equal everywhere and two of them combine to the rank of a longer prefix
by arithmetic (``Ranks.of``). What has to be sorted across the cluster is which ranks occur twice:

1. Each window (200-byte string) is filed under the position with the least 16-byte rank among its
   first 64, which equal windows choose alike. Spark sorts the chosen positions' 128-byte ranks
   together with the rank of everything their windows span. A position whose 128-byte rank is
   unique is dropped with all its windows; one whose whole span occurs again has only repeated windows.
2. For the positions left over (some span with this 128-byte rank is unique) the windows
   themselves are ranked at 200 bytes, the threshold, and sorted.
3. A last pass marks the bytes of repeated windows.

Every window of every text takes part; a window is repeated exactly if its 200-byte rank is (up
to 64-bit collisions, about 1 in 10,000 for 10^8 sorted ranks). Between passes, batches of
documents exchange packed ranks with shards (common.pack), so copies cost no more than other rows.

Defined results: a null text counts as empty; texts of fewer than 200 bytes lose nothing but are
returned; repeated rows are copies of each other; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import (
    PACKED, join_packed, mix, pack, query, release, shard_count, stage_batches, table, unpack, within,
)
from kinespark.session import stage

WINDOW = 200  # bytes of a string that must not occur twice
GRAM, REACH, PREFIX = 16, 64, 128  # REACH + PREFIX - 1 and REACH + GRAM - 1 stay within a window
CHUNK = 1 << 20  # bytes that are ranked at a time

BASE = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64(0xFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranks:
    """Ranks of prefixes at any position of some bytes, for any length."""

    powers = inverse = np.ones(1, np.uint64)
    letters = mix(np.arange(1, 257, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Ranks.powers) <= n:
            size = max(2 * CHUNK, n + 1)
            Ranks.powers = _powers(int(BASE), size)
            Ranks.inverse = _powers(pow(int(BASE), -1, 2**64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(Ranks.letters[data] * Ranks.inverse[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        """Two such ranks combine: of(i, k + m) = of(i, k) + of(i + k, m) x BASE^-k."""
        return (self.sums[at + length] - self.sums[at]) * Ranks.powers[at]


class Chunk:
    """Some texts laid end to end, with the positions that their windows are filed under."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ranks = Ranks(self.data)
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.at = empty
        n = len(self.data)
        if n < WINDOW:
            return
        grams = mix(self.ranks.of(np.arange(n - GRAM + 1), GRAM))
        least = (grams & ~PLACE) | (np.arange(len(grams), dtype=np.uint64) & PLACE)
        step = 1
        while step < REACH:  # doubling: the least of the next 2, 4, ... 64
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        starts = np.arange(n - WINDOW + 1)
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        fits = owner[starts] == owner[starts + WINDOW - 1]
        starts = starts[fits]
        if not len(starts):
            return
        chosen = starts + ((least[starts] - starts.astype(np.uint64)) & PLACE).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1])])
        self.at, self.first = chosen[new], starts[new]
        self.last = np.r_[starts[new[1:] - 1], starts[-1]]

    def prefixes(self) -> np.ndarray:
        return mix(self.ranks.of(self.at, PREFIX))

    def spans(self) -> np.ndarray:
        """Ranks of everything that the windows filed under a position cover, and of their places."""
        wide = self.ranks.of(self.first, self.last + WINDOW - self.first)
        where = ((self.at - self.first) * 4096 + self.last - self.first).astype(np.uint64)
        return mix(wide + mix(where))

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of all windows filed under the chosen positions."""
        first, count = self.first[which], self.last[which] - self.first[which] + 1
        ends = np.cumsum(count)
        return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)

    def window_ranks(self, starts: np.ndarray) -> np.ndarray:
        return mix(self.ranks.of(starts, WINDOW))


def chunks(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, about CHUNK bytes of texts)."""
    some: list[bytes] = []
    held = first = 0
    for k, text in enumerate(texts):
        some.append(text.encode() if isinstance(text, str) else b"")
        held += len(some[-1])
        if held >= CHUNK:
            yield first, some
            some, held, first = [], 0, k + 1
    if some:
        yield first, some


ANSWER = "batch int, kind string, ranks binary"


def _answers(rows: pd.DataFrame, kind: str, ranks: np.ndarray, owner: np.ndarray) -> list[tuple]:
    batch = rows["batch"].to_numpy()[owner]
    order = np.lexsort((ranks, batch))
    batch, ranks = batch[order], ranks[order]
    cuts = np.flatnonzero(np.diff(batch)) + 1
    return [
        (int(b[0]), kind, np.unique(r).tobytes())
        for b, r in zip(np.split(batch, cuts), np.split(ranks, cuts)) if len(b)
    ]


def _counts(sorted_values: np.ndarray) -> np.ndarray:
    """For each of the sorted values, how often it occurs."""
    new = np.r_[True, sorted_values[1:] != sorted_values[:-1]]
    return np.diff(np.r_[np.flatnonzero(new), len(new)])[np.cumsum(new) - 1]


def first_ranks(batches: DataFrame, shards: int) -> DataFrame:
    """Which spans occur again ("closed"), and which prefixes occur again with a span that does not ("open")."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, some in frame.groupby("batch"):
                parts = [(c.prefixes(), c.spans()) for _, t in chunks(some["text"]) for c in [Chunk(t)] if len(c.at)]
                if parts:
                    yield from pack(batch, shards, *map(np.concatenate, zip(*parts)))

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        prefix, span, owner = unpack(rows, np.uint64)
        order = np.lexsort((span, prefix))
        prefix, span, owner = prefix[order], span[order], owner[order]
        again = _counts(prefix) > 1
        prefix, span, owner = prefix[again], span[again], owner[again]
        if not len(prefix):
            return pd.DataFrame(columns=["batch", "kind", "ranks"])
        pair = np.cumsum(np.r_[False, (prefix[1:] != prefix[:-1]) | (span[1:] != span[:-1])])
        alone = _counts(pair) == 1
        open_ = within(np.unique(prefix[alone]), prefix)
        out = _answers(rows, "closed", span[~alone], owner[~alone]) + _answers(rows, "open", prefix[open_], owner[open_])
        return pd.DataFrame(out, columns=["batch", "kind", "ranks"])

    return stage(batches.select("batch", "text").mapInPandas(send, PACKED).groupBy("shard").applyInPandas(rank, ANSWER), "ranks")


def of_kind(answers: pd.DataFrame, kind: str) -> np.ndarray:
    return join_packed(answers.loc[answers["kind"] == kind, "ranks"], np.uint64)


def last_ranks(batches: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Which windows under open prefixes occur again ("window")."""

    def send(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        open_ = of_kind(found, "open")
        if not len(docs) or not len(open_):
            return pd.DataFrame(columns=["shard", "batch", "keys", "marks"])
        ranks = [c.window_ranks(c.windows(within(open_, c.prefixes()))) for _, t in chunks(docs["text"]) for c in [Chunk(t)]]
        keys = np.concatenate(ranks)
        # a rank that the batch sends twice is known to be repeated; it is sent once, with a mark
        keys, counts = np.unique(keys, return_counts=True)
        return next(pack(int(docs["batch"].iloc[0]), shards, keys, (counts > 1).astype(np.uint8)))

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        keys, many, owner = unpack(rows, np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, many, owner = keys[order], many[order], owner[order]
        again = (_counts(keys) > 1) | (many > 0)
        return pd.DataFrame(_answers(rows, "window", keys[again], owner[again]), columns=["batch", "kind", "ranks"])

    sent = batches.groupBy("batch").cogroup(answers.filter("kind = 'open'").groupBy("batch")).applyInPandas(send, PACKED)
    return stage(sent.groupBy("shard").applyInPandas(rank, ANSWER), "windows")


SPANS = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def mark(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """The removed runs of every document, and what is left of it as a digest."""

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        closed, open_, window = (of_kind(found, k) for k in ("closed", "open", "window"))
        out = []
        for _, texts in chunks(docs["text"]):
            chunk = Chunk(texts)
            whole = within(closed, chunk.spans())
            single = chunk.windows(~whole & within(open_, chunk.prefixes()))
            single = single[within(window, chunk.window_ranks(single))]
            edges = np.zeros(len(chunk.data) + 1, np.int64)
            np.add.at(edges, np.r_[chunk.first[whole], single], 1)
            np.add.at(edges, np.r_[chunk.last[whole] + WINDOW, single + WINDOW], -1)
            covered = np.cumsum(edges[:-1]) > 0
            for end, size, text in zip(chunk.ends, chunk.lengths, texts):
                own = covered[end - size : end]
                if size < WINDOW or not own.any():
                    out.append((size, 0, 0, hashlib.sha256(text).hexdigest(), [], []))
                    continue
                turns = np.flatnonzero(np.diff(np.r_[False, own, False]))
                left = np.frombuffer(text, np.uint8)[~own].tobytes()
                out.append((
                    size, int(own.sum()), len(turns) // 2, hashlib.sha256(left).hexdigest(),
                    turns[::2].tolist(), turns[1::2].tolist(),
                ))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])
        frame.insert(0, "doc_id", docs["doc_id"].to_numpy())
        return frame

    # ids go through pandas as text, which keeps their digits beside nulls
    texts = batches.withColumn("doc_id", F.col("doc_id").cast("string"))
    marked = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, SPANS)
    return marked.withColumn("doc_id", F.col("doc_id").cast("long"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): sizes, digest of what is kept, and the removed byte runs."""
    batches, count = stage_batches(docs, "doc_id", "text")
    shards = shard_count(count)
    ranks = first_ranks(batches, shards)
    release(docs.sparkSession)
    windows = last_ranks(batches, ranks, shards)
    release(docs.sparkSession)
    return mark(batches, ranks.unionByName(windows))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents")).drop("starts", "ends")
