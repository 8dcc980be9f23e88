"""Byte-level BPE against the tiktoken library, and its merges on small vocabularies against plain Python."""

import hashlib
import random

import pytest
import tiktoken

from kinespark.llm import byte_bpe

TRICKY = [
    "<|endoftext|> x", " lead", "trail ", "trail  ", "tab\t x \n  y", "x  y　 z", "\x00\x1c \x1d a", "é ﬁ Ⅳ ½", "🙂🙂 🙂", "don't  we'll'S",
    "===== =====", "  " * 300 + "x", "0123456789 12 3", "안녕 세계 שלום दुनिया 你好世界", "a࢏b ՘ \U00011de01 x꟎", "a" * 2500, "\n\n \n x",
]


def expected(rows):
    encoder = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.RANKS), special_tokens={})
    out = []
    for doc, text in rows:
        ids = encoder.encode_ordinary(text or "")
        assert encoder.decode(ids) == (text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


def test_awkward_and_tricky_texts_equal_the_library(spark, awkward):
    rows = [r[:2] for r in awkward[0]] + [(100 + k, t) for k, t in enumerate(TRICKY)]
    rows += [(9007199254740995, "big id"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(*r, "words", 5) for r in rows], "doc_id long, text string, words string, batch int")
    assert result(byte_bpe.encode(frame.repartition(3))) == expected(rows)


def test_query_equals_the_library(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(byte_bpe.op12_byte_bpe(spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""]])
def test_without_words(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert result(byte_bpe.encode(frame)) == expected(list(enumerate(texts)))


def test_merges_of_any_rank_order(spark, tmp_path):
    """Vocabularies whose longer tokens rank before their parts: one merge at a time, leftmost of the lowest rank."""
    import base64

    rng = random.Random(9)
    alone = [bytes([b]) for b in range(256)]
    longer = sorted({bytes(rng.choices(b"abc ", k=rng.choice([2, 2, 3, 4, 5]))) for _ in range(120)})
    rng.shuffle(longer)
    ranks = {t: k for k, t in enumerate(alone + longer)}
    path = tmp_path / "own.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {k}" for t, k in ranks.items()))
    encoder = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, "".join(rng.choices("abc ", weights=[5, 5, 3, 1], k=rng.randrange(1, 90)))) for k in range(300)]
    got = {r[0]: (r[1], r[2]) for r in byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), str(path)).collect()}
    for k, text in rows:
        ids = encoder.encode_ordinary(text)
        assert got[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), text


def test_pieces_have_the_words_of_the_text():
    cut = byte_bpe.cutter(byte_bpe.exact_pattern())
    for text in TRICKY:
        pack = byte_bpe.Pack(cut)
        pack.add(1, text)
        assert "".join(w.decode() for w in pack.row(0).column("words")[0].as_py()) != "" or not text
        pieces = [p[0] if isinstance(p, tuple) else " " + p for p in pack.pieces]
        again = [pieces[k] for k in pack.rows[0]]
        assert "".join(again) == text and [w for p in again for w in cut(p)] == cut(text)
