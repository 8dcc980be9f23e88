"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Conversations are rebuilt from a head that they share with another one and from their own later turns.
Identical rebuilt conversations collapse to one weighted sequence before any prefix is made: the identity
of a sequence is the sum of one hash per (position, turn), so it needs no sort, and a conversation that
occurs a million times goes on as one row with its weight, its smallest conv_id and its list of ends. Of
the collapsed sequences, those that are a proper prefix of another one are dropped by an anti-join; what
is left are the leaves. The prefixes of the sequences, weighted, are then grouped to nodes.

Sums over subtrees need no walk either. A node belongs to the sequence of its smallest member, and the
nodes of one sequence are the lower end of its path. So a node's subtree holds, of every other sequence
through it, all nodes of that sequence, and of its own sequence those from its depth on.

Identity of a sequence: its length and four sums of 32-bit hashes of (position, SHA-256 of the turn).

A conversation may hold a large share of all turns: turns are numbered and summed over blocks of
positions (``operators.layout``), joins on conv_id are left to skew handling, and lists of ends are
hashed as streams of sorted chunks, never as one value.

Defined results: rows with a null conv_id belong to no conversation and are left out; null role and text
are empty; turns with an equal number are ordered by role and text, repeated rows are turns of their own;
``c - c % 5`` truncates for negative ids, as in SQL; an empty table has no node, not even a root; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import query, table
from kinespark.operators.layout import enumerate_rows, running
from kinespark.session import stage

GROUP = 5  # conversations c - c % GROUP ... share their head
HEADS = 9  # a head has crc32(c) % HEADS turns
PARTS = ("h0", "h1", "h2", "h3")
HALF = 0xFFFFFFFF


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (0-based), turn_key (SHA-256 of role and text), n_bytes (of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text")
    )
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return enumerate_rows(turns, ["conv_id"], ["turn", "role", "text"]).select(
        "conv_id", "n", key.alias("turn_key"), F.octet_length("text").cast("long").alias("n_bytes")
    )


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their rebuilt turns (conv_id, depth from 1, turn_key, n_bytes)."""
    sizes = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = sizes.select("conv_id", base.alias("base"), head_length(F.col("conv_id")).alias("wanted")).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left"
    ).withColumn("head", F.least("wanted", F.coalesce("base_size", F.lit(0))))
    convs = stage(convs.drop("base_size"), "conversations")
    own = turns.filter(F.col("n") >= head_length(F.col("conv_id"))).join(convs, "conv_id").select(
        "conv_id", (F.col("n") - F.col("wanted") + F.col("head") + 1).alias("depth"), "turn_key", "n_bytes"
    )
    heads = turns.filter((F.col("n") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base").join(
        convs.filter("head > 0"), "base"
    ).filter("n < head").select("conv_id", (F.col("n") + 1).alias("depth"), "turn_key", "n_bytes")
    return convs.select("conv_id"), own.unionByName(heads)


def hashed(turns: DataFrame) -> DataFrame:
    """Add the four hash parts of every (depth, turn)."""
    both = [F.xxhash64(F.lit(seed), "depth", "turn_key") for seed in (1, 2)]
    halves = [part for h in both for part in (h.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(h, 32))]
    return turns.select("conv_id", "depth", "n_bytes", *[h.alias(p) for h, p in zip(halves, PARTS)])


def node_key(depth: Column, parts: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[p.cast("string") for p in parts]).cast("binary")))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the comma-joined conv_ids of each node, ascending.

    The ids are sorted by ranges, a hot node over many, and written as chunks of text; one pass per
    node then streams its chunks in order through the hash, holding one of them at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            starts = [k for k in range(len(nodes)) if not k or nodes[k] != nodes[k - 1]]
            if starts:
                cuts = list(zip(starts, [*starts[1:], len(nodes)]))
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([nodes[a] for a, _ in cuts], pa.binary()),
                    "first": pa.array([ids[a] for a, _ in cuts], pa.int64()),
                    "listed": [",".join(map(str, ids[a:b])) for a, b in cuts],
                })

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, listed in zip(batch.column("node").to_pylist(), batch.column("listed").to_pylist()):
                if key != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            yield made(done)
        if state:
            yield made([(node, state.hexdigest())])

    def made(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())],
            names=["node", "ends_sha256"],
        )

    listed = stage(
        ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
        .mapInArrow(chunks, "node binary, first long, listed string"), "ends",
    )
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rebuilt = rebuild(stage(numbered_turns(conversations), "turns"))
    rebuilt = stage(hashed(rebuilt), "rebuilt")

    # collapse: one row per distinct sequence
    whole = rebuilt.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), *[F.sum(p).alias(p) for p in PARTS])
    none = F.lit(0).cast("long")
    filled = {c: F.coalesce(c, none) for c in ("length", *PARTS)}
    ended = convs.join(whole, "conv_id", "left").select(
        "conv_id", filled["length"].alias("length"), node_key(filled["length"], [filled[p] for p in PARTS]).alias("node")
    )
    ended = stage(ended, "ended")
    sequences = stage(
        ended.groupBy("node", "length").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "sequences"
    )

    # prefixes of the sequences, from the root on
    at = running(
        sequences.select("conv_id", "weight").join(rebuilt, "conv_id"), ["conv_id"], "depth",
        totals={f"s_{p}": F.col(p) for p in PARTS},
    )
    deeper = at.select(
        "conv_id", "weight", "depth", "n_bytes", node_key(F.col("depth"), [F.col(f"s_{p}") for p in PARTS]).alias("node"),
        node_key(F.col("depth") - 1, [F.col(f"s_{p}") - F.col(p) for p in PARTS]).alias("parent"),
    )
    root = sequences.select(
        "conv_id", "weight", none.alias("depth"), none.alias("n_bytes"), node_key(none, [none] * len(PARTS)).alias("node"),
        F.lit(None).cast("binary").alias("parent"),
    )
    prefixes = stage(deeper.unionByName(root), "prefixes")
    nodes = stage(
        prefixes.groupBy("node", "parent", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
            ((F.sum("weight") - 1) * F.max("n_bytes")).alias("saved"),
        ), "nodes",
    )

    # leaves: sequences that are nobody's proper prefix
    leaves = sequences.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    # what each sequence owns, brought to all nodes on its path
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned")).join(
        leaves.select("conv_id", F.lit(1).cast("long").alias("leaf")), "conv_id", "left"
    )
    below = prefixes.select("conv_id", "node").join(owned, "conv_id").groupBy("node").agg(
        F.sum("owned").alias("below"), F.coalesce(F.sum("leaf"), none).alias("n_leaves")
    )
    above = running(
        nodes.select("conv_id", "depth", "node", "saved"), ["conv_id"], "depth", totals={"upto": F.col("saved")}
    ).select("node", (F.col("upto") - F.col("saved")).alias("above"))

    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hashes = end_hashes(ended.select("node", "conv_id"))
    return (
        nodes.join(below, "node").join(above, "node").join(children, "node", "left").join(hashes, "node", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
            (F.col("below") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


TRIE_SQL = """
WITH tbl AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
), ids AS (
  SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
), chars AS (
  SELECT c, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substring(s, i, 1)) AS BIGINT)) AS b FROM ids
), crc AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
                            lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS BIGINT) + 1])), 4294967295) % 9 AS h
  FROM chars, tbl
), orig AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT crc.c, 0 AS part, n, role, text FROM crc JOIN orig ON orig.c = crc.c - crc.c % 5 AND n <= h
  UNION ALL
  SELECT crc.c, 1 AS part, n, role, text FROM crc JOIN orig ON orig.c = crc.c AND n > h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d, sha256(length(role) || ':' || role || text) AS k,
         strlen(text) AS bytes FROM rebuilt
), paths AS (
  SELECT c, d, bytes, list(k) OVER w AS path FROM turns WINDOW w AS (PARTITION BY c ORDER BY d)
  UNION ALL SELECT c, 0, 0, [] FROM crc
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM paths GROUP BY path, d
), ends AS (
  SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e
  FROM (SELECT c, max_by(path, d) AS path FROM paths GROUP BY c) GROUP BY path
), links AS (
  SELECT path, path[1:d - 1] AS parent FROM nodes WHERE d > 0
), children AS (
  SELECT parent AS path, count(*) AS n FROM links GROUP BY parent
), up AS (
  SELECT n.path[1:a] AS path, sum(saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) n LEFT JOIN children k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       up.leaves AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM nodes n JOIN up ON up.path = n.path LEFT JOIN children k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN links l ON l.path = n.path LEFT JOIN nodes p ON p.path = l.parent
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))
