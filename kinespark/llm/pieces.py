"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read field by field; normaliser, metaspace marker, scores and byte
fallback are rebuilt from it. A unigram model keeps its scores; a BPE model's scores are the ranks
of its merges (the public model at hand is a BPE one). No piece of such a model has the marker inside,
so a text falls into units that start at a marker and are encoded independently; a task encodes
each new unit once, many at a time and on several threads, and remembers a bounded number of them.

Every document is decoded again and compared with its normalised text. The sentencepiece library normalises every
document and encodes every new unit, too. Where one of these differs or a unit stands for no text of its own, and for a hash
share of the documents besides (PARITY_SHARE), it encodes the whole document; a difference there raises an error.

Defined results: null is encoded as an empty text, which has no ids; repeated rows are encoded
each; an empty table gives an empty result; columns named ids, n_tokens or round_trip are replaced.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.llm.common import give_back, query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNITS = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
THREADS = 2
REMEMBERED = 400_000  # units a task remembers
ROWS = 256  # documents that are encoded together
PARITY_SHARE = 1 / 64  # of the documents that are checked whole whatever their units, by a hash of the text

# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; groups do not occur."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def read_model(path: str = MODEL) -> Model:
    """Parse the ModelProto: pieces (1), trainer settings (2) and normaliser settings (3)."""
    with open(path, "rb") as file:
        data = file.read()
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    if any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        raise ValueError("a piece has the marker inside: its texts do not fall into units")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score first."""
    number = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    ranked = [
        (-score, number[p[:k]], number[p[k:]], p[:k], p[k:])
        for p, score, kind in model.pieces if kind == NORMAL
        for k in range(1, len(p)) if p[:k] in number and p[k:] in number
    ]
    return [(left, right) for *_, left, right in sorted(ranked)]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str = MODEL, threads: int = THREADS, library=None):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer, models, normalizers

        self.model = read_model(path)
        unknown = next((k for k, x in enumerate(self.model.pieces) if x[2] == UNKNOWN), None)
        if self.model.kind == UNIGRAM:
            core = models.Unigram(
                [(p, s) for p, s, _ in self.model.pieces], unknown, byte_fallback=self.model.byte_fallback
            )
        elif self.model.kind == BPE:
            core = models.BPE(
                {p: k for k, (p, _, _) in enumerate(self.model.pieces)}, _merges(self.model),
                unk_token=self.model.pieces[unknown][0], fuse_unk=True, byte_fallback=self.model.byte_fallback,
            )
        else:
            raise ValueError(f"model type {self.model.kind} has no counterpart")
        self.units = Tokenizer(core)
        self.map = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        tokens = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARKER, " ").encode()
            for p, _, kind in self.model.pieces
        ]
        self.bytes = pa.array(tokens, pa.large_binary())
        self.library = library  # that new units are compared with
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.open: set[str] = set()  # known units on which the library does not agree by themselves
        self.ids = pa.array([], pa.large_list(pa.int32()))

    def normalise(self, text: str) -> str:
        if self.map:
            text = self.map.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def cut(self, text: str) -> list[str]:
        """The units of a normalised text: each starts at a marker, but for the first of a model without dummy prefix."""
        if text and self.model.dummy_prefix:
            text = " " + text
        if MARKER not in text and text[:1] == " " and text[-1:] != " " and "  " not in text:
            return text.replace(" ", " " + MARKER).split(" ")[1:]
        return UNITS.findall(text.replace(" ", MARKER))

    def look_up(self, cut: list[list[str]]) -> np.ndarray:
        """Rows of ``ids`` for all units, in order; those that are new to this codec are encoded in one threaded batch."""
        known = self.known
        new = list({u for units in cut for u in units}.difference(known))
        if known and len(known) + len(new) > REMEMBERED:
            self.forget()
            return self.look_up(cut)
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            found = [x.ids for x in self.units.encode_batch_fast(new, add_special_tokens=False)]
            if self.library:
                alone = [self.model.dummy_prefix and u[0] == MARKER and MARKER not in u[1:] for u in new]
                theirs = self.library.encode([u[1:] if a else "" for u, a in zip(new, alone)])
                self.open.update(u for u, a, own, their in zip(new, alone, found, theirs) if not a or own != their)
            self.ids = pa.concat_arrays([self.ids, pa.array(found, pa.large_list(pa.int32()))])
        return np.fromiter((known[u] for units in cut for u in units), np.int64, sum(map(len, cut)))

    def encode_normal(self, texts: list[str]) -> pa.ListArray:
        """Ids of each normalised text."""
        cut = [self.cut(t) for t in texts]
        rows = self.look_up(cut)
        self.unsure = [k for k, units in enumerate(cut) if not self.open.isdisjoint(units)] if self.open else []
        taken = self.ids.take(pa.array(rows))
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(), dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pc.list_flatten(taken))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_normal([self.normalise(t) for t in texts]).to_pylist()

    def decode_bytes(self, ids: pa.ListArray) -> list[memoryview]:
        """The joined bytes of each text's ids, less the space of a dummy prefix."""
        taken = self.bytes.take(ids.values)
        if not len(taken):
            return [memoryview(b"")] * len(ids)
        data = memoryview(taken.buffers()[2]).cast("B")
        cuts = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ids.offsets.to_numpy()]
        drop = int(self.model.dummy_prefix)
        return [data[s + (drop and data[s : s + 1] == b" ") : e] for s, e in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return bytes(self.decode_bytes(pa.array([ids], pa.list_(pa.int32())))[0]).decode("utf-8", "replace")


def in_parity_share(text: str, share: float = PARITY_SHARE) -> bool:
    return zlib.crc32(text.encode()) < share * 2**32


def encoded(batches: Iterator[pa.RecordBatch], model: str, threads: int, share: float) -> Iterator[pa.RecordBatch]:
    """A task's batches with ids, n_tokens and round_trip added."""
    from sentencepiece import SentencePieceProcessor

    checker = SentencePieceProcessor(model_file=model)
    codec = Codec(model, threads, checker)
    lead = MARKER if codec.model.dummy_prefix else ""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            normal = [codec.normalise(t) for t in texts]
            ids = codec.encode_normal(normal)
            unsure = {*codec.unsure, *(
                k for k, (t, own) in enumerate(zip(checker.normalize(texts), normal)) if t != (own and lead + own.replace(" ", MARKER))
            )}
            checked = [k for k, t in enumerate(texts) if k in unsure or in_parity_share(t, share)]
            values, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            for k, theirs in zip(checked, checker.encode([texts[k] for k in checked])):
                if not np.array_equal(values[at[k] : at[k + 1]], theirs):
                    raise ValueError(f"the encoders differ on a text that begins with {texts[k][:80]!r}")
            same = [found == t.encode() for found, t in zip(codec.decode_bytes(ids), normal)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, ids, pc.list_value_length(ids).cast(pa.int64()), pa.array(same, pa.bool_())],
                names=[*batch.schema.names, "ids", "n_tokens", "round_trip"],
            )


def encode_task(batches: Iterator[pa.RecordBatch], model: str, threads: int, share: float) -> Iterator[pa.RecordBatch]:
    """``encoded``, after which the codec's memory is handed back: an idle worker would keep it beside the next stages."""
    give_back()
    yield from encoded(batches, model, threads, share)
    give_back()


def encode(docs: DataFrame, model: str = MODEL, threads: int = THREADS, share: float = PARITY_SHARE) -> DataFrame:
    """Add ids, n_tokens and round_trip (decoding gives back the normalised text) to every row.

    All texts are compared with the library by normal form and units, a ``share`` of them also as a whole.
    """
    kept = docs.drop("ids", "n_tokens", "round_trip")
    schema = T.StructType([
        *kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()),
    ])

    return kept.mapInArrow(lambda batches: encode_task(batches, model, threads, share), schema)


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
