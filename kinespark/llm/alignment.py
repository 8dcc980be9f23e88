"""Alignment of two tokenizers over a corpus, in Arrow arrays.

Documents are cut into segments that both sides encode independently; each distinct segment that a task
meets is aligned as a small document of its own and remembered while it is among those met most. Both encodings of a batch of them are list arrays. They
are flattened with their parent indices; a cumulative sum of token lengths, started anew at every segment,
gives the byte offset at which each token ends; an Acero hash join on (segment, end) finds the tokens of both
sides that end together. One document in 64 is also aligned uncut, by the tokenizers library itself, and a difference raises an error. Pairs of
linked ids are counted by ``Table.group_by`` in each task and the partial counts merged by Spark. A
last pass brings the counts back to the documents' links.

The counts that every task gets are bounded by the vocabularies, not by the corpus: tokens that end at the
same byte of one text are suffixes of each other, so at most :func:`pair_limit` pairs can occur
(324 300 for the two public vocabularies, 16 bytes each); more than ``LOOKUP_PAIRS`` is an error before
any work.

Side A encodes a space and the text with a byte-level BPE of the tokenizers library, side B the text
with a SentencePiece model that adds the space itself. Names of special tokens inside texts are text.
The tiktoken library encodes the segments of side A where it is known to give the same ids
(:func:`same_ids`, :func:`odd_points`), the tokenizers library all others.

Defined results: null and empty texts, and texts whose joined token bytes differ from space and text
on either side, have no tokens: zeros and an empty ``groups_sha256``; every row, a repeated one or one with
a null doc_id too, is aligned and counted for itself; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import query, table
from kinespark.llm.pieces import in_parity_share
from kinespark.session import stage

SIDE_A = "/opt/tokenizers/byte_bpe_50k.json"
SIDE_B = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENTS = re.compile(r" [\s\S]+?(?=(?<=\S) [\s\S]|\Z)")
UNEVEN = re.compile(r"\s |\s\Z|\A ")  # texts without it are cut at every space
CHUNK_BYTES = 2_000_000  # text that is aligned at a time; a longer text is a chunk of its own
REMEMBERED = 250_000  # segments that a task remembers
IN_A_ROW = 300  # segments that are encoded as one text
TEXTS_AT_ONCE = 100  # whose ids are lists of Python
LONG = 1_000  # characters; longer segments are left to the tokenizers library, whose time does not grow with the square of a word
LINKS_AT_ONCE = 500_000  # links that are counted or scored at a time
LOOKUP_PAIRS = 20_000_000  # no pair of vocabularies may be able to give more
SHIFT = 1 << 32  # a pair is a * SHIFT + b
# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SEGMENT = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "good": pa.bool_(), "groups": pa.large_binary(),
    "links": pa.large_list(pa.int64()),
}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others, in order, for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


def side_a_bytes(described: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary (ids of special tokens: none)."""
    model, alphabet = json.loads(described)["model"], byte_alphabet()
    out = [b""] * (max(model["vocab"].values()) + 1)
    for token, number in model["vocab"].items():
        out[number] = bytes(alphabet[c] for c in token)
    return out


def same_ids(described: str) -> bool:
    """Whether merging the pair whose joined bytes have the lowest id gives side A's ids.

    So it is if ids follow the order of the merges, every token but the single bytes has one merge, and every token's bytes
    are merged to that token: neighbours whose joined bytes are a token have then been merged as that token's bytes are when
    they stand alone, so they are the pair of its one merge.
    """
    from tokenizers import Tokenizer, models

    whole, alphabet = json.loads(described), byte_alphabet()
    model = whole["model"]
    if whole.get("normalizer") or not all(t["special"] for t in whole.get("added_tokens") or []) or model.get("type") != "BPE":
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return False
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    numbers = [vocab[left + right] for left, right in merges]
    if any(x >= y for x, y in zip(numbers, numbers[1:])) or not alphabet.keys() <= vocab.keys():
        return False
    if sorted([*numbers, *(vocab[c] for c in alphabet)]) != sorted(vocab.values()):
        return False
    alone = Tokenizer(models.BPE(vocab, merges)).encode_batch_fast(list(vocab), add_special_tokens=False)
    return [e.ids for e in alone] == [[k] for k in vocab.values()]


def odd_points() -> str:
    """A pattern that finds the code points that only one of the two libraries takes for a letter, digit or white space
    ("" if there are none)."""
    import tiktoken
    from tokenizers import Regex, pre_tokenizers

    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    alone = {bytes([b]): b for b in range(256)}
    differing: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = bytes(tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=alone, special_tokens={}).encode_ordinary(whole)).decode()
        own = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True)
        found = [piece for at in range(0, len(whole), 4096) for piece, _ in own.pre_tokenize_str(whole[at : at + 4096])]
        differing |= set("".join(found)) ^ set(theirs)
    codes = np.array(sorted(map(ord, differing)), int)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1) if len(codes) else []
    return f"[{''.join(f'\\U{r[0]:08x}-\\U{r[-1]:08x}' for r in runs)}]" if runs else ""


def side_b_bytes(model: bytes) -> list[bytes]:
    """Bytes of every piece: its UTF-8 with the marker as a space, or the byte that it falls back to."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=model)
    return [
        bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k)
        else pieces.id_to_piece(k).replace("▁", " ").encode()
        for k in range(pieces.get_piece_size())
    ]


def pair_limit(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together: one token's bytes must be a suffix of the other's."""
    of_a, of_b = Counter(a), Counter(b)
    shorter_b = sum(of_b[t[k:]] for t in a for k in range(len(t)))
    return shorter_b + sum(of_a[t[k:]] for t in b for k in range(1, len(t)))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def _ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, their segments, and the byte offset in the segment at which each token ends."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.take(sizes, flat))
    # what earlier segments sum to: the running sum at the last token before each segment
    padded = pa.concat_arrays([pa.array([0], upto.type), upto])
    before = pc.take(padded, pc.subtract(ids.offsets[:-1], ids.offsets[0]))
    return flat, parents, pc.subtract(upto, pc.take(before, parents))


def _slices(values: pa.LargeBinaryArray, counts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values, and where each run of ``counts`` values starts and ends in them."""
    data = memoryview(values.buffers()[2] or b"").cast("B")
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1 + values.offset)[values.offset :] if len(values) else np.zeros(1, np.int64)
    return data, at[np.concatenate([[0], np.cumsum(counts)])]


def _joined(ids: pa.ListArray, tokens: pa.Array) -> Iterator[memoryview]:
    """The joined token bytes of every segment."""
    data, cuts = _slices(pc.take(tokens, pc.list_flatten(ids)), pc.list_value_length(ids).to_numpy())
    return (data[s:e] for s, e in zip(cuts[:-1], cuts[1:]))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return upto[ends[1:]] - upto[ends[:-1]]


def segments_of(text: str) -> list[str]:
    """The segments of space + text, each without its first space."""
    if not text:
        return []
    if UNEVEN.search(text):
        return [s[1:] for s in SEGMENTS.findall(" " + text)]
    return text.split(" ")


def cut_texts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct segments of all texts, the numbers among them of each text's segments in order, and how many each text has."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = pc.list_flatten(parts).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    numbers, counts = coded.indices.to_numpy(), pc.list_value_length(parts).to_numpy()
    # a text whose parts are all there and end in no white space is cut at every space
    uneven = np.array([not s or s[-1].isspace() for s in names], bool)
    if not uneven.any():
        return names, numbers, counts
    uncut = _sums(uneven[numbers], counts) > 0
    place = {s: k for k, s in enumerate(names)}
    again = [[place.setdefault(s, len(place)) for s in segments_of(texts[k])] for k in np.flatnonzero(uncut)]
    order = np.argsort(np.concatenate([np.flatnonzero(~uncut), np.flatnonzero(uncut)]))
    even = pa.ListArray.from_arrays(parts.offsets, coded.indices).filter(pa.array(~uncut))
    lists = pa.concat_arrays([even, _lists(again)]).take(pa.array(order))
    used, numbers = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
    names = list(place)
    return [names[k] for k in used], numbers, pc.list_value_length(lists).to_numpy()


class Aligner:
    """Both encoders, and what is known of the segments met so far.

    A segment is a stretch of space + text that starts at a space behind something that is no white
    space. Neither side has a token across such a place, so a segment is encoded and aligned alike wherever
    it occurs: each is aligned once while it is remembered, and documents are put together from
    their segments. When there are too many, those met least are forgotten.

    ``odd`` finds the texts that side A must take the tokenizers library for; None: all.
    """

    def __init__(self, described: str, model: bytes, odd: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(described), SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        a, b = side_a_bytes(described), side_b_bytes(model)
        check_segments(described, b)
        self.quick, self.odd = None, re.compile(odd).search if odd else None
        if odd is not None:
            import tiktoken

            ranks = {t: k for k, t in enumerate(a) if t}
            self.quick = tiktoken.Encoding("side a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [pa.array(t, pa.large_binary()) for t in (a, b)]
        self.sizes = [pa.array([len(x) for x in t], pa.int64()) for t in (a, b)]
        # an id's text with what follows it: A "," or "|", B "," or ";"
        self.printed = pa.array(
            [f"{k}{after}" for k in range(len(a)) for after in ",|"] + [f"{k}{after}" for k in range(len(b)) for after in ",;"],
            pa.large_string(),
        )
        self.index: dict[str, int] = {}
        self.known = pa.table({name: pa.array([], kind) for name, kind in SEGMENT.items()})
        self.met = np.zeros(0, np.int64)  # how often each known segment was met

    def forget(self) -> None:
        """Keep the half that was met most; what was met long ago counts less."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
        names = list(self.index)
        self.index = {names[k]: n for n, k in enumerate(kept)}
        self.known = self.known.take(pa.array(kept)).combine_chunks()
        self.met = self.met[kept] // 2

    def ids_a(self, texts: list[str], longest: int | None) -> list[list[int]]:
        """Side A's ids; texts with more than ``longest`` characters are left to the tokenizers library."""
        slow = [
            k for k, t in enumerate(texts)
            if self.quick is None or longest is not None and len(t) > longest or self.odd and not t.isascii() and self.odd(t)
        ]
        found = dict(zip(slow, self.a.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False))) if slow else {}
        return [found[k].ids if k in found else self.quick(t) for k, t in enumerate(texts)]

    def encode_texts(self, texts: list[str], longest: int | None) -> tuple[list[pa.ListArray], list[bool]]:
        """Ids of both sides, and where both give the text back."""
        parts, good = [[_lists([])], [_lists([])]], []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at : at + TEXTS_AT_ONCE]
            sides = [_lists(self.ids_a(some, longest)), _lists(self.b.encode([t[1:] for t in some], num_threads=1))]
            whole = [t.encode() for t in some]
            same = [[x == w for x, w in zip(_joined(ids, tokens), whole)] for ids, tokens in zip(sides, self.tokens)]
            good += [p and q for p, q in zip(*same)]
            for part, ids in zip(parts, sides):
                part.append(ids)
        return [pa.concat_arrays(part) for part in parts], good

    def encode_alone(self, segments: list[str], longest: int = LONG) -> tuple[list[pa.ListArray], list[bool]]:
        """The same, with no ids where either side does not give the segment back."""
        sides, good = self.encode_texts(segments, longest)
        if not all(good):
            sides = [_lists([x if g else [] for x, g in zip(ids.to_pylist(), good)]) for ids in sides]
        return sides, good

    def encode(self, segments: list[str]) -> tuple[list[pa.ListArray], list[bool]]:
        """The same; segments that end in no white space are one text to the encoders, IN_A_ROW at a time."""
        alone = [k for k, s in enumerate(segments) if len(s) > LONG or s[-1].isspace()]
        apart = set(alone)
        rows = [k for k in range(len(segments)) if k not in apart] if apart else list(range(len(segments)))
        rows = [rows[at : at + IN_A_ROW] for at in range(0, len(rows), IN_A_ROW)]
        sides, good = self.encode_texts(["".join([segments[k] for k in row]) for row in rows], None)
        if not all(good):
            alone += [k for row, g in zip(rows, good) if not g for k in row]
            rows, sides = [row for row, g in zip(rows, good) if g], [ids.filter(pa.array(good)) for ids in sides]
        placed = [k for row in rows for k in row]
        ends = np.cumsum(pc.binary_length(pa.array([segments[k] for k in placed], pa.large_string())).to_numpy())
        cut = []
        for ids, sizes in zip(sides, self.sizes):
            flat = pc.list_flatten(ids)
            cuts = np.searchsorted(pc.cumulative_sum(pc.take(sizes, flat)).to_numpy(), ends, "right")
            cut.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), flat))
        if not alone:
            return cut, [True] * len(segments)
        apart_ids, apart_good = self.encode_alone([segments[k] for k in alone])
        order = np.argsort(placed + alone)
        good = np.concatenate([np.ones(len(placed), bool), np.array(apart_good, bool)])[order]
        return [pa.concat_arrays(x).take(pa.array(order)) for x in zip(cut, apart_ids)], good.tolist()

    def align(self, segments: list[str], encode: Callable | None = None) -> pa.Table:
        """The alignment of each segment: SEGMENT."""
        (ids_a, ids_b), good = (encode or self.encode)(segments)
        (a, of_a, end_a), (b, of_b, end_b) = (_ends(x, s) for x, s in zip((ids_a, ids_b), self.sizes))
        left = pa.table({"segment": of_a, "end": end_a, "i": np.arange(len(a))})
        right = pa.table({"segment": of_b, "end": end_b, "j": np.arange(len(b))})
        links = left.join(right, ["segment", "end"], join_type="inner", use_threads=False).sort_by("i")
        i, j = links["i"].to_numpy(), links["j"].to_numpy()
        n_a, n_b = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (ids_a, ids_b))
        n_links = np.bincount(links["segment"].to_numpy(), minlength=len(segments))
        pairs = pc.take(a, links["i"]).to_numpy().astype(np.int64) * SHIFT + pc.take(b, links["j"]).to_numpy()
        listed = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(n_links)]), pairs)
        columns = [n_a, n_b, n_links, np.array(good, bool), self._groups(a, b, i, j, n_a + n_b), listed]
        return pa.table({name: pa.array(c) if isinstance(c, np.ndarray) else c for name, c in zip(SEGMENT, columns)})

    def _groups(self, a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Each segment's printed groups, all closed by ";"; ``i`` and ``j`` are the tokens that end a group."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[i], closes_b[j] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        codes = np.empty(len(a) + len(b), np.int64)
        # a group's B tokens stand behind its A tokens
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a.to_numpy() * 2 + closes_a
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = (len(self.tokens[0]) + b.to_numpy()) * 2 + closes_b
        printed = pc.take(self.printed, pa.array(codes))
        cuts = np.frombuffer(printed.buffers()[1], np.int64, len(printed) + 1)[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), printed.buffers()[2]])

    def look_up(self, names: list[str]) -> np.ndarray:
        """Rows of ``known`` for distinct segments; new ones are aligned together."""
        new = [s for s in names if s not in self.index]
        if self.index and len(self.index) + len(new) > REMEMBERED:
            self.forget()
            new = [s for s in names if s not in self.index]
        index = self.index
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.known = pa.concat_tables([self.known, self.align([" " + s for s in new])]).combine_chunks()
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        return np.fromiter(map(index.__getitem__, names), np.int64, len(names))

    def documents(self, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        names, numbers, counts = cut_texts(texts)
        rows = self.look_up(names)[numbers]
        self.met += np.bincount(rows, minlength=len(self.met))
        known = {name: self.known[name].chunk(0) if len(self.known) else pa.array([], kind) for name, kind in SEGMENT.items()}
        bad = ~known["good"].to_numpy(zero_copy_only=False)
        good = _sums(bad[rows], counts) == 0
        if not good.all():
            rows = rows[np.repeat(good, counts)]
            counts = counts * good
        n_a, n_b, n_links = (_sums(known[c].to_numpy()[rows], counts) for c in ("n_a", "n_b", "n_links"))
        data, cuts = _slices(known["groups"].take(pa.array(rows)), counts)
        sealed = [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(cuts[:-1], cuts[1:])]
        flat = memoryview(pc.list_flatten(known["links"].take(pa.array(rows))).to_numpy()).cast("B")
        ends = np.concatenate([[0], np.cumsum(n_links)]) * 8
        stored = [pa.compress(flat[s:e], "zstd", asbytes=True) if e > s else b"" for s, e in zip(ends[:-1], ends[1:])]
        out = pa.RecordBatch.from_arrays(
            [doc_ids, *map(pa.array, (n_a, n_b, n_links, n_links)), pa.array(sealed, pa.string()), pa.array(stored, pa.binary())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
        )
        self.check(texts, out)
        return out

    def check(self, texts: list[str], out: pa.RecordBatch) -> None:
        """Align a share of the texts uncut, side A by the tokenizers library, and compare."""
        checked = [k for k, t in enumerate(texts) if t and in_parity_share(t)]
        if checked:
            whole = self.align([" " + texts[k] for k in checked], lambda found: self.encode_alone(found, 0))
            for k, row in zip(checked, whole.select(["n_a", "n_b", "n_links", "groups"]).to_pylist()):
                mine = [out.column(c)[k].as_py() for c in ("n_a", "n_b", "n_links", "groups_sha256")]
                groups = row["groups"][:-1]
                if mine != [row["n_a"], row["n_b"], row["n_links"], hashlib.sha256(groups).hexdigest() if groups else ""]:
                    raise ValueError(f"segments are aligned differently in a text that begins with {texts[k][:80]!r}")


def check_segments(described: str, b: list[bytes]) -> None:
    """Refuse vocabularies that may have tokens across the places where segments start."""
    cutter = json.loads(described)["pre_tokenizer"] or {}
    if cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space"):
        raise ValueError("side A must cut texts by the byte-level pattern, without a space of its own")
    if any(b" " in t.lstrip(b" ") for t in b):
        raise ValueError("a piece of side B has a space inside")


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    marks = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(marks[:-1])) + 1), batch.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(s, e - s)


def align(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """Aligned documents with their links as pairs; the vocabularies travel with the tasks."""
    with open(side_a, encoding="utf-8") as file:
        described = file.read()
    with open(side_b, "rb") as file:
        model = file.read()
    if pair_limit(side_a_bytes(described), side_b_bytes(model)) > LOOKUP_PAIRS:
        raise ValueError("these vocabularies can link more pairs than a task may hold")
    odd = odd_points() if same_ids(described) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(described, model, odd)
            for chunk in _chunks(batch):
                if chunk.num_rows:
                    yield aligner.documents(chunk.column("doc_id"), [t or "" for t in chunk.column("text").to_pylist()])
        del aligner
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with about LINKS_AT_ONCE links, and these links' pairs in order."""
    n_links = batch.column("n_links").to_numpy()
    marks = np.concatenate([[0], np.cumsum(n_links)]) // LINKS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(marks[:-1])) + 1), batch.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:]):
        part = batch.slice(s, e - s)
        stored = zip(part.column("links"), n_links[s:e])
        found = [np.frombuffer(pa.decompress(x.as_buffer(), int(n) * 8, "zstd"), np.int64) for x, n in stored if n]
        yield part, np.concatenate(found) if found else np.zeros(0, np.int64)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair, and whether no pair with its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for _, pairs in _unpacked(batch):
                counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                both = pa.concat_tables([held, counted.rename_columns({"count_all": "n"}).select(["pair", "n"])])
                held = both.group_by("pair", use_threads=False).aggregate([("n", "sum")])
                held = held.rename_columns({"n_sum": "n"}).select(["pair", "n"])
        yield from held.combine_chunks().to_batches()

    partial = aligned.select("n_links", "links").mapInArrow(run, "pair long, n long")
    same_b = Window.partitionBy(F.col("pair") % SHIFT)
    return partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("best", F.col("n") == F.max("n").over(same_b))


def score(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add n_best and count_sum to the documents and drop their links."""
    lookup = pairs.orderBy("pair").toArrow().combine_chunks()  # at most pair_limit rows
    keys, counts, best = (lookup.column(c).to_numpy() for c in ("pair", "n", "best"))
    kept = [f for f in aligned.schema.fields if f.name != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, links in _unpacked(batch):
                at = np.searchsorted(keys, links)
                sums = [pa.array(_sums(values[at], part.column("n_links").to_numpy())) for values in (best, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *sums], names=[*(f.name for f in kept), "n_best", "count_sum"]
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def corpus_alignment(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    aligned = stage(align(docs, side_a, side_b), "aligned")
    return score(aligned, stage(count_pairs(aligned), "pairs"))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    return corpus_alignment(table(spark, sf_dir, "documents"))
