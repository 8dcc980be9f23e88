"""Piece encoding on a small unigram model that is written here, against the sentencepiece library."""

import gc
import struct

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from kinespark.llm import pieces


def field(number, value):
    """One field of a protobuf message."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    listed = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    own = {"▁": -3.0, "▁the": -2.1, "the": -4.0, "t": -5.5, "h": -5.6, "e": -5.0, "▁th": -3.3, "he": -4.1, "in": -3.9, "g": -5.7, "i": -5.1,
           "n": -5.2, "ing": -3.0, "▁in": -3.1, "a": -4.9, "b": -6.0, "ab": -8.5, "ba": -7.0, "aba": -12.0, "é": -7.1, "▁▁": -6.5}
    listed += [(p, score, pieces.NORMAL) for p, score in own.items()]
    data = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in listed)
    trainer = field(3, pieces.UNIGRAM) + field(4, len(listed)) + field(35, 1)
    normaliser = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data + field(2, trainer) + field(3, normaliser))
    return str(path)


TEXTS = ["the thing in the bath", "abababa ab aba", "ééé é", "zzz the 🙂 q", " the", "the ", "a  b", "", "in\nthe\tbath", "▁the", "x" * 400, None]


def test_unigram_scores_and_byte_fallback_equal_the_library(spark, unigram):
    library = SentencePieceProcessor(model_file=unigram)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(frame, unigram, share=1.0).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k]["ids"] == library.encode(text or ""), text
        assert got[k]["n_tokens"] == len(got[k]["ids"])
        assert got[k]["round_trip"] == (text != "▁the")
    codec = pieces.Codec(unigram)
    assert codec.decode(library.encode("the 🙂 é")) == "the 🙂 é"


def test_units_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    codec, library = pieces.Codec(), SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [f"word{k} and {k % 3}  more\n{k}" for k in range(40)]
    assert [codec.encode([t])[0] for t in texts] == library.encode(texts) == codec.encode(texts)


def test_every_text_is_compared_with_the_library(spark, monkeypatch):
    class Other:
        def __init__(self, model_file):
            self.own = SentencePieceProcessor(model_file=model_file)

        def normalize(self, texts):
            return self.own.normalize(texts)

        def encode(self, texts):
            return [[0] if "odd" in t else ids for t, ids in zip(texts, self.own.encode(texts))]

    frame = spark.createDataFrame([(0, "the same"), (1, "odd one out")], "doc_id long, text string")
    run = {}
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, f, schema: run.setdefault("f", f))
    pieces.encode(frame)
    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Other)
    assert not pieces.in_parity_share("odd one out")
    with pytest.raises(ValueError, match="odd one out"):
        list(run["f"](iter(pa.Table.from_pydict({"doc_id": [0, 1], "text": ["the same", "odd one out"]}).to_batches())))


def test_a_task_hands_back_what_its_codec_held(unigram, monkeypatch):
    def codecs():
        return sum(isinstance(x, pieces.Codec) for x in gc.get_objects())

    handed = []
    monkeypatch.setattr(pieces, "give_back", lambda: handed.append(codecs()))
    before = codecs()
    batches = [pa.RecordBatch.from_pydict({"text": ["the thing", None, "in the bath"]})] * 2
    during = [(b.num_rows, codecs()) for b in pieces.encode_task(iter(batches), unigram, 1, 1.0)]
    assert during == [(3, before + 1)] * 2
    assert handed == [before, before]  # at the start, and at the end when the codec is gone
