"""The trie of rebuilt conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from kinespark.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, node string, depth int"


def brute_trie(rows):
    """[(conv_id, turn, role, text)] → sorted node rows."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = {p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path}
        parents = {p[:-1] for p in nodes if p}
        ends = sorted(c for c, p in rebuilt.items() if p == path)
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
            sum(p not in parents for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def awkward_turns():
    rng = random.Random(5)
    rows = [(None, 0, "user", "left out"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (2**60 + 5, 0, "", "é")]
    rows += [(-7, 3, "user", "negative"), (-5, 0, "user", "base of -7"), (9007199254740993, 0, "user", "a"), (9007199254740995, 0, "user", "b")]
    for c in range(1, 60):
        if c % 11:
            for turn in range(rng.choice([1, 2, 5, 9, 14])):
                rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["yes", "no", "x" * 3000])))
    rows += [(c, turn, "user", "alike") for c in range(100, 400) for turn in range(12)]
    rows += [(500, turn, "user", f"long {turn}") for turn in range(700)] + [(501, turn, "user", f"long {turn}") for turn in range(699)]
    return rows


def test_awkward_conversations_equal_plain_python(spark):
    rows = awkward_turns()
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], COLUMNS)
    assert rows_of(prefix_trie.trie(frame)) == brute_trie(rows)


def test_long_conversations_are_numbered_by_ranges(spark, monkeypatch):
    rows = awkward_turns()
    monkeypatch.setattr(prefix_trie, "enumerate_rows", lambda df, keys, order, numbered=prefix_trie.enumerate_rows: numbered(df, keys, order, limit=50))
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], COLUMNS)
    assert rows_of(prefix_trie.trie(frame)) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_without_conversations_there_is_no_node(spark, rows):
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], COLUMNS)
    assert prefix_trie.trie(frame).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    # crc32("1") % 9 turns of conversation 0, which is absent, and none of its own are left
    assert zlib.crc32(b"1") % 9 > 0
    got = rows_of(prefix_trie.trie(spark.createDataFrame([(1, 0, "user", "x", "extra", 1)], COLUMNS)))
    assert got == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_lists_of_ends_are_hashed_over_many_chunks(spark):
    ids = list(range(25_000)) + [2**53 + 1, 2**53 + 3]
    ends = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 7)], "node binary, conv_id long")
    got = {bytes(r[0]): r[1] for r in prefix_trie.end_hashes(ends.repartition(5)).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}
