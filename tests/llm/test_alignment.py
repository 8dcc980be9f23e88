"""Tokenizer alignment against whole-text encoders and plain Python."""

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kinespark.llm import alignment

TRICKY = [
    "<|endoftext|> plain <s> </s> <unk>", "a▁b", "▁", " ", "  ", "\n", " lead", "trail ", "trail  ", "tab\t x \n  y", "x  y　 z",
    "\x00\x1c \x1d a", "é ﬁ Ⅳ ½", "🙂🙂 🙂", "don't  we'll", "===== =====", "a" * 3000, "  " * 500 + "x", "0123456789 12 3",
]


def brute(rows):
    """[(doc_id, text)] → sorted result rows, from whole texts."""
    a, b = Tokenizer.from_file(alignment.SIDE_A), SentencePieceProcessor(model_file=alignment.SIDE_B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def bytes_a(i):
        return bytes(alphabet[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc, text in rows:
        whole, sides = (" " + text).encode() if text else b"", []
        if text:
            sides = [
                [(i, bytes_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids],
                [(i, bytes_b(i)) for i in b.encode(text)],
            ]
        if not text or any(b"".join(x for _, x in side) != whole for side in sides):
            docs.append((doc, None, []))
            continue
        ends = []
        for side in sides:
            at, found = 0, {}
            for i, x in side:
                at += len(x)
                found[at] = i
            ends.append(found)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        groups = [([], []) for _ in cuts]
        for side, found in enumerate(ends):
            for end, i in found.items():
                groups[bisect_left(cuts, end)][side].append(str(i))
        groups = ["|".join(",".join(side) for side in group) for group in groups]
        count.update(links)
        docs.append((doc, (len(sides[0]), len(sides[1]), groups), links))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc, found, links in docs:
        n_a, n_b, groups = found or (0, 0, [])
        sealed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sealed))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_awkward_and_tricky_texts_equal_whole_text_encoders(spark, awkward):
    rows = [r[:2] for r in awkward[0]] + [(100 + k, t) for k, t in enumerate(TRICKY)]
    rows += [(9007199254740995, "big id"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(*r, "links", 5) for r in rows], "doc_id long, text string, links string, n_a int")
    assert result(alignment.corpus_alignment(frame.repartition(3))) == brute(rows)


def test_query_equals_whole_text_encoders(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(alignment.op11_tokenizer_alignment(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("remembered, at_once", [(50, 400), (3000, 1)])
def test_memory_and_chunks_do_not_change_the_result(monkeypatch, remembered, at_once):
    import pyarrow as pa

    with open(alignment.SIDE_A, encoding="utf-8") as file:
        described = file.read()
    with open(alignment.SIDE_B, "rb") as file:
        model = file.read()
    texts = [f"word{k % 70} and  {k} \n" + t for k, t in enumerate(TRICKY * 6)]
    usual = alignment.Aligner(described, model).documents(pa.array(range(len(texts))), texts)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "IN_A_ROW", 7)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", at_once)
    aligner = alignment.Aligner(described, model)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = [aligner.documents(c.column("doc_id"), c.column("text").to_pylist()) for c in alignment._chunks(batch)]
    assert len(parts) > 1
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([usual]).to_pylist()


@pytest.fixture(scope="module")
def sides():
    with open(alignment.SIDE_A, encoding="utf-8") as file:
        described = file.read()
    with open(alignment.SIDE_B, "rb") as file:
        return described, file.read()


def test_segments_met_often_are_aligned_once(monkeypatch, sides):
    """F op11: a task forgot all segments at once and aligned the common ones again and again."""
    monkeypatch.setattr(alignment, "REMEMBERED", 200)
    aligner, aligned = alignment.Aligner(*sides), Counter()
    align = aligner.align
    monkeypatch.setattr(aligner, "align", lambda found, *how: aligned.update(found) or align(found, *how))
    monkeypatch.setattr(alignment, "in_parity_share", lambda text: False)
    common = " ".join(f"common{k}" for k in range(50))
    for k in range(60):
        aligner.documents(pa.array([k]), [f"{common} {common} " + " ".join(f"rare{k}x{j}" for j in range(20))])
        assert len(aligner.index) == len(aligner.known) == len(aligner.met) <= 200
    assert sum(aligned.values()) == len(aligned) == 50 + 60 * 20


def test_side_a_is_left_to_the_tokenizers_library_only_where_ids_may_differ(monkeypatch, sides):
    assert alignment.same_ids(sides[0])
    texts = [f"{t} word{k} don't {t}" for k, t in enumerate(TRICKY)] + ["ж中文 ٣٤", "x " * 400 + "y" * 1500, "\u2028 \u0085x ", ""]
    usual = alignment.Aligner(*sides).documents(pa.array(range(len(texts))), texts)
    monkeypatch.setattr(alignment, "in_parity_share", lambda text: False)
    for odd in ("", "[é-🙂]"):
        aligner, asked = alignment.Aligner(*sides, odd), []
        library = aligner.a
        aligner.a = type("Library", (), {
            "encode_batch_fast": lambda self, some, **how: asked.extend(some) or library.encode_batch_fast(some, **how),
        })()
        assert aligner.documents(pa.array(range(len(texts))), texts).to_pylist() == usual.to_pylist()
        assert {" " + "y" * 1500, " " + "a" * 3000} <= set(asked)
        assert any("🙂" in t for t in asked) == bool(odd)
        assert not any(t.isascii() and len(t) <= alignment.LONG for t in asked)


def test_odd_points_are_those_of_one_library(monkeypatch):
    import tiktoken

    usual = alignment.odd_points()
    assert not usual or not re.search(usual, "aé1½ \u3000中ж٣")
    monkeypatch.setattr(tiktoken, "Encoding", lambda *names, pat_str, real=tiktoken.Encoding, **rest: real(
        *names, pat_str=pat_str.replace(r"\p{L}", "[a-y]"), **rest
    ))
    odd = re.compile(alignment.odd_points())
    assert odd.search("z") and odd.search("é") and not odd.search("a1 ")


def test_vocabularies_that_merge_otherwise_are_not_taken_for_the_same(sides):
    plain = json.loads(sides[0])
    for change in (
        lambda x: x["model"]["merges"].reverse(), lambda x: x["model"].update(unk_token="a"), lambda x: x["model"]["merges"].pop(),
        lambda x: x.update(normalizer={"type": "NFC"}), lambda x: x["added_tokens"][0].update(special=False),
    ):
        other = json.loads(sides[0])
        change(other)
        assert other != plain and not alignment.same_ids(json.dumps(other))


def test_texts_are_cut_like_each_alone():
    texts = ["", " ", "a b", "a  b c", "a \u2003b a", "b a ", " a b", "b\n a", "b\n", "a"] + TRICKY
    names, numbers, counts = alignment.cut_texts(texts)
    assert len(set(names)) == len(names) and set(numbers) == set(range(len(names)))
    found = iter(names[k] for k in numbers)
    assert [[next(found) for _ in range(n)] for n in counts] == [alignment.segments_of(t) for t in texts]
    assert [len(x) for x in alignment.cut_texts([])] == [0, 0, 0]
    assert alignment.cut_texts(["", ""])[2].tolist() == [0, 0]


def test_pairs_are_bounded_by_suffixes():
    a, b = [b"a", b"ba", b" ba"], [b"a", b"a", b" ba", b"c"]
    pairs = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x.endswith(y) or y.endswith(x)}
    assert alignment.pair_limit(a, b) == len(pairs)


def test_empty_table(nothing):
    assert alignment.corpus_alignment(nothing).count() == 0
