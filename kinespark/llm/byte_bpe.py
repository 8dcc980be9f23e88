"""Byte-level BPE encoding and decoding: merges folded in Spark over the distinct words of a corpus.

``pack`` cuts the texts of a task into batches, the texts of a batch into words (the matches of the
vocabulary's pattern), and keeps of a batch its distinct words and, for every document, their numbers. The
words of all batches are stored in buckets of the word, so that distinct words, their merges and the answers to
the batches need no further shuffle. The merges are higher-order functions: a word's bytes become ids, and
a fold joins, step by step, the leftmost pair of lowest rank; a word that is a token needs none. Ranks come
from one literal table, pairs of ids to the rank of what they join to, filed in small maps so that a look-up
doesn't search it. A last pass
puts the ids of every document together and decodes them by concatenating the tokens' bytes.

The same words are found as by the tiktoken library: where this machine's Unicode tables know letters or
digits that the library's don't, those are taken out of the pattern.

A word is folded in steps that copy its ids, so time grows with the square of a single word's length
(words, not texts: 20 000 letters without a break take seconds).

Defined results: null is encoded as an empty text, which has no ids; every row, a repeated one or one with a
null doc_id too, is encoded for itself; names of special tokens are text; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm.alignment import segments_of
from kinespark.llm.common import batch_count, let, query, stage_bucketed, table
from kinespark.session import stage

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACK_BYTES = 32_000_000  # text of one batch; a longer text is a batch of its own
NONE = 2**31 - 1  # the rank of pairs that join to nothing
PIECES_AT_ONCE = 300_000  # that are put together to documents at a time; a longer document is taken whole
WIDTH = 2**20  # ids are below this
BUCKETS = 65_537  # maps of the rank table

PACK = "batch long, doc_ids array<long>, sizes binary, pieces binary, piece_sizes binary, piece_words binary, words array<binary>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: for each of BUCKETS remainders, the pairs (left id * WIDTH + right id) and what they join to,
    and the tokens by their CRC-32."""
    filed: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    whole: list[dict[bytes, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        whole[zlib.crc32(token) % BUCKETS][token] = rank
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                key = left * WIDTH + right
                filed[key % BUCKETS][key] = rank
    return stage(spark.createDataFrame([(filed, whole)], "filed array<map<long,int>>, whole array<map<binary,int>>"), "ranks")


def merged(word: Column, filed: Column, whole: Column, byte_ids: list[int]) -> Column:
    """The ids of a word (binary): its own if it is a token, else by folding its merges."""
    own = F.lit(byte_ids)
    ids = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.get(own, F.ascii(c)))

    def fold(ranked: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            key = left.cast("long") * WIDTH + right
            return F.coalesce(F.element_at(F.get(ranked, (key % BUCKETS).cast("int")), key), F.lit(NONE))

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(state["ranks"]), lambda low: F.when(
                low < NONE, let(F.array_position(state["ranks"], low).cast("int"), lambda at: join(state["ids"], state["ranks"], low, at))
            ).otherwise(state))

        def join(ids: Column, ranks: Column, low: Column, at: Column) -> Column:
            """Ids and ranks after the pair that starts at ``at`` (from 1) has become the id ``low``."""
            size, none = F.size(ids), F.array().cast("array<int>")
            before = F.when(at > 1, F.array(rank(F.get(ids, at - 2), low))).otherwise(none)
            after = F.when(at + 1 < size, F.array(rank(low, F.get(ids, at + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, size)).alias("ids"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, size)).alias("ranks"),
            )

        def folded(ids: Column) -> Column:
            pairs = F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda x, k: rank(x, F.get(ids, k + 1)))
            return F.aggregate(
                F.array_repeat(F.lit(0), F.size(ids) - 1), F.struct(ids.alias("ids"), pairs.alias("ranks")), step, lambda s: s["ids"]
            )

        return let(ids, folded)

    token = F.element_at(F.get(whole, (F.crc32(word) % BUCKETS).cast("int")), word)
    return let(token, lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(let(filed, fold)))


def exact_pattern() -> tuple[str, str]:
    """The pattern for the regex module with the library's own letters and digits, and a pattern that
    finds the code points that make a difference ("" if there are none)."""
    import regex
    import tiktoken

    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    alone = {bytes([b]): b for b in range(256)}
    pattern, odd = PATTERN, ""
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = bytes(tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=alone, special_tokens={}).encode_ordinary(whole))
        differing = sorted(set(regex.findall(kind, whole)) ^ set(theirs.decode()))
        if differing:
            codes = np.array([ord(c) for c in differing])
            runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
            listed = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
            odd += listed
            pattern = pattern.replace(kind, f"[{kind}~~[{listed}]]")
    return f"(?V1){pattern}", f"[{odd}]" if odd else ""


def cutter(patterns: tuple[str, str]) -> Callable[[str], list[str]]:
    """Words of a stretch of text."""
    import regex

    usual, exact = regex.compile(PATTERN), regex.compile(patterns[0])
    odd = regex.compile(patterns[1]) if patterns[1] else None

    def cut(text: str) -> list[str]:
        return (usual if odd is None or text.isascii() or not odd.search(text) else exact).findall(text)

    return cut


def _packed(values: list[int] | np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, "<u4")
    planes = np.frombuffer(pa.decompress(data, count * 4, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Pack:
    """One batch while it is filled: documents as numbers of pieces, pieces as numbers of words.

    A piece starts at a space behind something that is no white space. No word reaches across such a place,
    so a piece that occurs again has the same words.
    """

    def __init__(self, cut: Callable[[str], list[str]]):
        self.cut = cut
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.rows: list[np.ndarray] = []
        self.pieces: dict[str | tuple[str], int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found, numbers = segments_of(text), self.pieces
        if found:
            found[0] = (found[0],)  # the only one without a space before it
        self.rows.append(np.fromiter((numbers.setdefault(p, len(numbers)) for p in found), "<u4", len(found)))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(found))
        self.bytes += len(text.encode())

    def row(self, batch: int) -> pa.RecordBatch:
        """The batch with pieces numbered by frequency and words in order, which compresses best."""
        used = np.concatenate(self.rows)
        order = np.argsort(-np.bincount(used, minlength=len(self.pieces)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        pieces = list(self.pieces)
        found = [self.cut(p[0] if isinstance(p, tuple) else " " + p) for p in (pieces[k] for k in order)]
        words = sorted({w for ws in found for w in ws})
        number = {w: k for k, w in enumerate(words)}
        listed = [number[w] for ws in found for w in ws]
        one = {
            "batch": batch, "doc_ids": self.doc_ids, "sizes": _packed(self.sizes), "pieces": _packed(rank[used]),
            "piece_sizes": np.array([len(pieces), len(listed)], "<u4").tobytes() + _packed([len(ws) for ws in found]),
            "piece_words": _packed(listed), "words": [w.encode() for w in words],
        }
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), kinds)], names=list(one))


def pack(docs: DataFrame) -> DataFrame:
    """The batches of every task, bucketed by batch as they are written: without a shuffle."""
    patterns = exact_pattern()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, batch = cutter(patterns), TaskContext.get().partitionId() << 32
        held = Pack(cut)
        for frame in frames:
            for doc_id, text in zip(frame.column("doc_id").to_pylist(), frame.column("text")):
                held.add(doc_id, text.as_py() or "")
                if held.bytes >= PACK_BYTES:
                    yield held.row(batch)
                    held, batch = Pack(cut), batch + 1
        if held.doc_ids:
            yield held.row(batch)

    return stage_bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACK), 2 * batch_count(docs), "packs")


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _bytes_of(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of large binary values and the places between them."""
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    cuts = np.frombuffer(values.buffers()[1], np.int64, values.offset + len(values) + 1)[values.offset :]
    return memoryview(values.buffers()[2] or b"").cast("B"), cuts


def _spread(lists: pa.LargeListArray, rows: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    """Lists joined from ``sizes`` consecutive lists at ``rows``."""
    taken = lists.take(pa.array(rows, pa.int64()))
    upto = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(), dtype=np.int64)])
    cuts = upto[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
    return pa.LargeListArray.from_arrays(pa.array(cuts), pc.list_flatten(taken))


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of every row."""
    spark, known = docs.sparkSession, load_ranks(ranks)
    if max(known.values()) >= WIDTH:
        raise ValueError(f"ids must be below {WIDTH}")
    tokens = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        tokens[rank] = token
    packs = pack(docs)
    buckets = batch_count(docs)
    asked = stage_bucketed(
        packs.select("batch", F.posexplode("words").alias("k", "word")).repartition(buckets, "word").sortWithinPartitions("word"),
        buckets, "words", "word",
    )
    byte_ids = [known[bytes([b])] for b in range(256)]
    literal = rank_table(spark, known)
    tables = {name: literal.select(name).scalar() for name in literal.columns}
    encoded = asked.select("word").distinct().withColumns(tables).select(
        "word", merged(F.col("word"), F.col("filed"), F.col("whole"), byte_ids).alias("ids")
    )
    answers = asked.join(encoded.hint("merge"), "word").select("batch", "k", "ids")

    def assemble(batch: pa.Table, answered: pa.Table) -> pa.Table:
        printed = pa.array([f"{k}," for k in range(len(tokens))], pa.large_string())
        pieces = pa.array(tokens, pa.large_binary())
        answered = answered.sort_by("k")
        words = answered["ids"].cast(pa.large_list(pa.int32())).combine_chunks()
        out = []
        for row in batch.to_pylist():
            n_pieces, n_words = np.frombuffer(row["piece_sizes"][:8], "<u4")
            of_pieces = _spread(words, _unpacked(row["piece_words"], n_words), _unpacked(row["piece_sizes"][8:], n_pieces))
            sizes = _unpacked(row["sizes"], len(row["doc_ids"])).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            numbers = _unpacked(row["pieces"], int(upto[-1]))
            cuts = [0, *(np.flatnonzero(np.diff(upto[:-1] // PIECES_AT_ONCE)) + 1), len(sizes)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                of_docs = _spread(of_pieces, numbers[upto[first] : upto[last]], sizes[first:last])
                ends, sealed = of_docs.offsets.to_numpy(), []
                for values, drop in ((printed, 1), (pieces, 0)):
                    data, at = _bytes_of(values.take(of_docs.values))
                    sealed.append([hashlib.sha256(data[s : max(s, e - drop)]).hexdigest() for s, e in zip(at[ends[:-1]], at[ends[1:]])])
                out.append(pa.table({
                    "doc_id": pa.array(row["doc_ids"][first:last], pa.int64()), "n_tokens": np.diff(ends),
                    "ids_sha256": pa.array(sealed[0], pa.string()), "decoded_sha256": pa.array(sealed[1], pa.string()),
                }))
        del words, of_pieces, of_docs, numbers
        pa.default_memory_pool().release_unused()  # the worker goes on to other batches
        return pa.concat_tables(out)

    kept = packs.drop("words")
    return kept.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(assemble, ENCODED)


@query("op12_byte_bpe")
def op12_byte_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
