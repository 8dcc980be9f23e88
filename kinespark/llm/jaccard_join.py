"""Heavy-light Jaccard join on word shingles.

A set that reaches the wished similarity with another one shares most of its elements with it. The
join orders elements from rare to frequent and needs only the first ones of each set (its prefix):

* light (small) sets enumerate all 2-subsets of their prefix; two similar light sets have one in common;
* heavy (large) sets scan inverted lists of their prefix elements; so do those light sets that are
  large enough to be similar to a heavy one;
* the boundary is the size at which the enumerated subsets and scanned list entries cost least, from
  their sums per size class.

Before that, two passes leave out sets that cannot have a partner: of a set's least hashes, enough
must occur in other sets too. Equal sets are represented by one. Sets that share a subset or list are
not expanded into all pairs: each key's members are compared with one pivot at a time, in waves, and
in the end the pairs of a key that are not yet connected and not yet compared. So no link between
different components is missed, while a group of thousands of near copies costs a few comparisons
each.

Shingles are 64-bit hashes of words. Defined results: null, empty and blank texts have no shingles and
are linked with nothing; fewer words than ``WORDS`` make one shingle; equal sets are linked; every row is a
document, also where ids are null or repeated (a component of null ids only has a null component_id); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import (
    PACKED, batch_of, give_back, join_packed, mix, pack, query, release, shard_count, stage_batches, stage_bucketed, table,
    unpack, within,
)
from kinespark.llm.graph import components
from kinespark.llm.suffix_dedup import CHUNK, Ranks
from kinespark.operators.layout import enumerate_rows
from kinespark.session import stage

# Values of op3's contract; the pipeline passes its own.
WORDS = 4
PERCENT = 85
CARRIED = 256  # classes of a prefix that are carried along to tell the first common key
WAVES = 4  # of single pivots, before the rest is compared

FACTORS = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Small letter of each byte, and whether it separates words."""
    small = np.arange(256, dtype=np.uint8)
    small[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return small, space


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    small, space = _tables()
    data = small[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = ~space[data]
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False]))
    first, last = edge[::2], edge[1::2]
    hashed = mix(Ranks(data).of(first, last - first) + mix((last - first).astype(np.uint64)))
    owner = np.searchsorted(ends, first, "right")
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(0, len(hashed) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashed[k : k + n] * FACTORS[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * FACTORS[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(hashed[:0])
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def needed_upwards(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with a similar set that is not smaller."""
    return -(-2 * percent * n // (100 + percent))


def probe(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(how many of the least hashes to look at, how many of them must occur elsewhere)."""
    spare = n - needed(n, percent)
    length = min(n, 2 * spare + 1)
    return length, length - spare


def shown(n: int, percent: int = PERCENT) -> int:
    """How many of its least hashes a set must show, so that every similar set finds enough of its own among them.

    Of the common elements the largest similar set needs the first few; at most the spare ones of this set lie between.
    """
    return min(n, probe(100 * n // percent, percent)[1] + n - needed(n, percent))


def shown_hashes(texts: list[bytes], words: int, percent: int) -> list[np.ndarray]:
    """The least hashes that each text's set must show, as arrays of their own: a slice would hold its whole set."""
    return [s[: shown(len(s), percent)].copy() for s in shingle_sets(texts, words)]


def text_chunks(texts: pd.Series) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    held = 0
    for text in texts:
        some.append(text.encode() if isinstance(text, str) else b"")
        held += len(some[-1])
        if held >= CHUNK:
            yield some
            some, held = [], 0
    if some:
        yield some


ANSWER = "batch int, keys binary, counts binary"


def _common_keys(sent: DataFrame) -> DataFrame:
    """To each batch: those of its keys that two sets or more have, and how many have them."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        keys, many, owner = unpack(rows, np.uint32)
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, many)[at]
        again = total > 1
        keys, total, owner = keys[again], total[again], owner[again]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        out = [
            (int(batch), keys[a:b].tobytes(), np.minimum(total[a:b], 2**32 - 1).astype(np.uint32).tobytes())
            for batch, a, b in zip(rows["batch"], cuts[:-1], cuts[1:]) if b > a
        ]
        return pd.DataFrame(out, columns=["batch", "keys", "counts"])

    return sent.groupBy("shard").applyInPandas(count, ANSWER)


MEMBERS = np.dtype([("n", "<u4"), ("who", "<u8")])  # how many sets have an element, and the sum of their hashes


def _frequencies(sent: DataFrame) -> DataFrame:
    """To each batch: those of its elements that two sets or more have, with MEMBERS."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        keys, marks, owner = unpack(rows, MEMBERS)
        distinct, at = np.unique(keys, return_inverse=True)
        total, who = np.bincount(at, marks["n"]), np.zeros(len(distinct), np.uint64)
        np.add.at(who, at, marks["who"])
        again = total[at] > 1
        keys, at, owner = keys[again], at[again], owner[again]
        found = np.empty(len(keys), MEMBERS)
        found["n"], found["who"] = np.minimum(total[at], 2**32 - 1), who[at]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        out = [
            (int(batch), keys[a:b].tobytes(), found[a:b].tobytes())
            for batch, a, b in zip(rows["batch"], cuts[:-1], cuts[1:]) if b > a
        ]
        return pd.DataFrame(out, columns=["batch", "keys", "counts"])

    return sent.groupBy("shard").applyInPandas(count, ANSWER)


def _packed(batch: int, shards: int, parts: list[np.ndarray]) -> pd.DataFrame:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    return next(pack(batch, shards, keys, counts.astype(np.uint32)))


SETS = "doc_id string, batch int, n long, digest string, hashes binary"  # ids as text: pandas turns numbers with nulls to floats


def likely_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """Every row's doc_id and set size; digest and hashes only where a partner is possible."""
    batches, count = stage_batches(docs, "doc_id", "text")
    batches = batches.withColumn("doc_id", F.col("doc_id").cast("string"))
    shards = shard_count(count)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for frame in frames:
            for batch, some in frame.groupby("batch"):
                yield _packed(batch, shards, [h for t in text_chunks(some["text"]) for h in shown_hashes(t, words, percent)])

    common = stage(_common_keys(batches.select("batch", "text").mapInPandas(send, PACKED)), "common")
    release(docs.sparkSession)

    def choose(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        give_back()
        known = join_packed(found["keys"], np.uint64)
        out = []
        for texts in text_chunks(rows["text"]):
            for s in shingle_sets(texts, words):
                length, least = probe(len(s), percent)
                if len(s) and within(known, s[:length]).sum() >= least:
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), s.tobytes()))
                else:
                    out.append((len(s), None, None))
        frame = pd.DataFrame(out, columns=["n", "digest", "hashes"])
        frame.insert(0, "doc_id", rows["doc_id"].to_numpy())
        frame.insert(1, "batch", rows["batch"].to_numpy())
        return frame

    sets = batches.groupBy("batch").cogroup(common.groupBy("batch")).applyInPandas(choose, SETS)
    return stage_bucketed(sets.withColumn("doc_id", F.col("doc_id").cast("long")), count, "sets"), count


PREFIX = (
    "doc_id long, n long, shared long, single int, index1 int, index2 int, classes array<long>, firsts array<int>,"
    " seconds array<int>, counts array<long>"
)
PREFIX_NAMES = [x.split()[0] for x in PREFIX.split(", ")]
NEVER = 2**31 - 1


def prefixes(sets: DataFrame, chosen: DataFrame, batches: int, percent: int) -> DataFrame:
    """Per chosen set the classes of its prefix: of the elements that other sets have too, rare ones first.

    Elements that the very same sets have form a class, as a passage's do. Two sets that have a 2-subset or a
    list in common have one of the elements' classes in common, so the join runs on classes and a shared passage counts
    once, not once per pair of its elements. ``firsts`` and ``seconds`` are the places of a class's first two elements.

    The prefix is one element longer than lists need; ``single`` elements belong to the shorter one.
    ``index1`` and ``index2`` elements belong to the still shorter prefixes that meet any set that is not smaller
    in a list or a 2-subset.
    ``shared`` counts all elements of the set that other sets have too: no overlap is larger.
    """
    shards = shard_count(batches)
    held = sets.filter("hashes IS NOT NULL").select("batch", "doc_id", "n", "hashes")

    def send(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["doc_id"].isin(own["doc_id"])]
        if not len(mine):
            return pd.DataFrame(columns=["shard", "batch", "keys", "marks"])
        parts = [np.frombuffer(h, np.uint64) for h in mine["hashes"]]
        who = np.repeat(mix(mine["doc_id"].to_numpy(np.int64).view(np.uint64) + np.uint64(1)), [len(s) for s in parts])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        marks = np.zeros(len(keys), MEMBERS)
        marks["n"] = np.bincount(at)
        sums = np.zeros(len(keys), np.uint64)
        np.add.at(sums, at, who)
        marks["who"] = sums
        return next(pack(int(rows["batch"].iloc[0]), shards, keys, marks))

    sent = held.groupBy("batch").cogroup(chosen.groupBy("batch")).applyInPandas(send, PACKED)
    common = stage(_frequencies(sent), "frequencies")
    answers = common.unionByName(chosen, allowMissingColumns=True)

    def order(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        give_back()
        keys = [np.frombuffer(k, np.uint64) for k in found["keys"] if k is not None]
        marks = [np.frombuffer(k, MEMBERS) for k in found["counts"] if k is not None]
        own = rows[rows["doc_id"].isin(found["doc_id"].dropna())]
        if not keys or not len(own):
            return pd.DataFrame(columns=PREFIX_NAMES)
        keys, marks = np.concatenate(keys), np.concatenate(marks)
        by = np.argsort(keys)
        keys, marks = keys[by], marks[by]
        out = []
        for doc, n, hashes in zip(own["doc_id"], own["n"], own["hashes"]):
            s = np.frombuffer(hashes, np.uint64)
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            df = np.where(keys[at] == s, marks["n"][at], 1).astype(np.int64)
            first = np.lexsort((s, df))[: n - needed(n, percent) + 2]
            place = np.flatnonzero(df[first] > 1)
            up = n - needed_upwards(n, percent)
            lengths = [int((place < k).sum()) for k in (n - needed(n, percent) + 1, up + 1, up + 2)]
            who = marks["who"][at[first[place]]].astype(np.int64)
            classes, firsts, inverse = np.unique(who, return_index=True, return_inverse=True)
            later = np.ones(len(who), bool)
            later[firsts] = False
            seconds = np.full(len(classes), NEVER)
            np.minimum.at(seconds, inverse[later], np.flatnonzero(later))
            turn = np.argsort(firsts)
            out.append((
                doc, n, int((df > 1).sum()), *lengths, classes[turn], firsts[turn].astype(np.int32),
                seconds[turn].astype(np.int32), df[first[place]][firsts[turn]],
            ))
        return pd.DataFrame(out, columns=PREFIX_NAMES)

    return stage(held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(order, PREFIX), "prefixes")


def boundary(prefix: DataFrame, percent: int = PERCENT) -> int:
    """The least size of a heavy set, by cost; size classes differ by the wished similarity."""
    ratio = -math.log(percent / 100)
    m = F.size("classes")
    subsets = m * (m - 1) / 2 + F.size(F.filter("seconds", lambda x: x < NEVER))
    scanned = F.aggregate(
        F.zip_with("counts", "firsts", lambda c, k: F.when(k < F.col("single"), c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    found = prefix.groupBy(F.floor(F.log("n") / ratio).cast("int").alias("c")).agg(
        F.sum(subsets).alias("light"), F.sum(scanned).alias("heavy"),
    ).collect()  # a row per size class: some hundred at most
    sums = {r["c"]: (float(r["light"]), float(r["heavy"])) for r in found}
    best = min(
        range(max(sums, default=0) + 2),
        key=lambda x: sum(lt for c, (lt, _) in sums.items() if c < x) + sum(h for c, (_, h) in sums.items() if c >= x - 1),
    )
    return math.ceil(math.exp(best * ratio))


def _subset_key(x: Column, y: Column) -> Column:
    return F.xxhash64(F.lit("subset"), F.least(x, y), F.greatest(x, y))


def _list_key(x: Column) -> Column:
    return F.xxhash64(F.lit("list"), x)


def keys_of(prefix: DataFrame, heavy: int, percent: int = PERCENT) -> DataFrame:
    """(key, upwards, doc_id, n, shared): subsets of light sets, list entries of heavy sets and of those that may be similar to one.

    A subset is one of two classes, or of two elements of one class. Sets of one element have no 2-subset and
    are filed by the element. Keys that a set needs to meet sets that are not smaller are marked ``upwards``.
    """
    c = F.col("classes")
    mixed = F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y, k: F.struct(
        _subset_key(x, y).alias("key"),
        (F.get("firsts", i + k + 1) < F.col("index2")).alias("upwards"),
    ))))
    alike = F.filter(
        F.transform(c, lambda x, i: F.struct(
            _subset_key(x, x).alias("key"), (F.get("seconds", i) < F.col("index2")).alias("upwards"),
            (F.get("seconds", i) < NEVER).alias("there"),
        )), lambda k: k["there"],
    )
    alike = F.transform(alike, lambda k: F.struct(k["key"].alias("key"), k["upwards"].alias("upwards")))
    lists = F.transform(
        F.filter(F.arrays_zip(c.alias("x"), F.col("firsts").alias("k")), lambda z: z["k"] < F.col("single")),
        lambda z: F.struct(_list_key(z["x"]).alias("key"), (z["k"] < F.col("index1")).alias("upwards")),
    )
    none = F.array().cast("array<struct<key:bigint,upwards:boolean>>")
    light, listed = (F.col("n") < heavy) & (F.col("n") > 1), (100 * F.col("n") >= percent * heavy) | (F.col("n") == 1)
    keys = F.concat(F.when(light, F.concat(mixed, alike)).otherwise(none), F.when(listed, lists).otherwise(none))
    possible = 100 * F.col("shared") >= percent * F.col("n")
    return prefix.filter(possible).select(F.explode(keys).alias("k"), "doc_id", "n", "shared").select("k.*", "doc_id", "n", "shared")


LINKS = "a long, b long, overlap long, union long"


def compare(pairs: DataFrame, sets: DataFrame, batches: int) -> DataFrame:
    """Overlap and union of the pairs (a, b), with a's batch as the place of comparison.

    A set that several members of a batch are compared with is sent to that batch once.
    """
    held = sets.filter("hashes IS NOT NULL").select("batch", "doc_id", "hashes")
    placed = pairs.select(batch_of("a", batches).alias("batch"), "a", "b")
    wanted = placed.select(batch_of("b", batches).alias("home"), F.col("batch").alias("to"), "b").distinct()

    def fetch(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=["batch", "b", "hashes"])
        found = asked.merge(rows.drop_duplicates("doc_id"), left_on="b", right_on="doc_id")
        return pd.DataFrame({"batch": found["to"], "b": found["b"], "hashes": found["hashes"]})

    moved = held.groupBy("batch").cogroup(wanted.withColumnRenamed("home", "batch").groupBy("batch")).applyInPandas(
        fetch, "batch int, b long, hashes binary"
    )

    def measure(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        give_back()
        jobs, sent = asked[asked["hashes"].isna()], asked[asked["hashes"].notna()]
        if not len(jobs):
            return pd.DataFrame(columns=["a", "b", "overlap", "union"])
        mine = set(jobs["a"])
        own = {d: np.frombuffer(h, np.uint64) for d, h in zip(rows["doc_id"], rows["hashes"]) if d in mine}
        other = {d: np.frombuffer(h, np.uint64) for d, h in zip(sent["b"], sent["hashes"])}
        out = []
        for a, b in zip(jobs["a"], jobs["b"]):
            x, y = own[a], other[b]
            overlap = int(within(x, y).sum())
            out.append((a, b, overlap, len(x) + len(y) - overlap))
        return pd.DataFrame(out, columns=["a", "b", "overlap", "union"])

    asked = placed.unionByName(moved, allowMissingColumns=True)
    return held.groupBy("batch").cogroup(asked.groupBy("batch")).applyInPandas(measure, LINKS)


def link(prefix: DataFrame, heavy: int, sets: DataFrame, batches: int, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the sets that are linked with another one."""
    spark, keys = prefix.sparkSession, keys_of(prefix, heavy, percent)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    open_ = stage(keys.join(shared, "key").withColumn("comp", F.col("doc_id")), "keys")
    tested = spark.createDataFrame([], "a long, b long")
    links = spark.createDataFrame([], "a long, b long, pivot boolean")
    found = spark.createDataFrame([], "node long, component long")
    # the overlap is at most what either set shares with any other one
    most = F.least("shared", "shared_b", "n", "n_b")
    possible = 100 * most >= percent * (F.col("n") + F.col("n_b") - most)

    def judge(pairs: DataFrame) -> DataFrame:
        asked = stage(pairs.join(tested, ["a", "b"], "left_anti"), "asked")
        return stage(compare(asked, sets, batches), "compared")

    def regroup(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Renew the components and keep the keys whose members are not all connected."""
        renamed = rows.drop("comp").join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "doc_id", "left")
        renamed = renamed.withColumn("comp", F.coalesce("comp", "doc_id"))
        split = renamed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        return stage(renamed.join(split.select("key"), "key"), "keys")

    waves, left = 0, None
    while True:
        sums = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
            F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
        state = sums.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not state["rows"]:
            break
        last = waves >= WAVES or (waves and (state["pairs"] <= 2 * state["rows"] or state["pairs"] > 0.9 * left))
        if last:
            pairs = _pairs_by_first_key(open_, prefix, percent)
        else:
            # the centre of a group of near copies has the fewest elements of its own; earlier pivots come last
            degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.max("pivot").alias("was"))
            ranked = open_.join(degree.withColumnRenamed("a", "doc_id"), "doc_id", "left")
            rank = F.struct(
                ~F.coalesce("was", F.lit(False)), F.round(F.col("shared") / F.col("n"), 2).alias("common"),
                F.coalesce("links", F.lit(0).cast("long")), F.xxhash64("doc_id"), F.col("doc_id").alias("b"),
                F.col("n").alias("n_b"), F.col("shared").alias("shared_b"), F.col("comp").alias("comp_b"),
            )
            pivots = ranked.groupBy("key").agg(F.max(rank).alias("p")).select("key", "p.b", "p.n_b", "p.shared_b", "p.comp_b")
            pairs = open_.join(pivots, "key")
        pairs = pairs.filter((F.col("comp") != F.col("comp_b")) & possible).select(F.col("doc_id").alias("a"), "b").distinct()
        compared = judge(pairs)
        tested = tested.unionByName(compared.select("a", "b"))
        linked = compared.filter(100 * F.col("overlap") >= percent * F.col("union"))
        links = links.unionByName(linked.select("a", "b", F.lit(False).alias("pivot"))).unionByName(
            linked.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("pivot")))
        found = components(links.select("a", "b"))
        if last:
            break
        left = state["pairs"]
        open_ = regroup(open_, found)
        waves += 1
    return found


def _pairs_by_first_key(open_: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a key which the smaller set needs to meet sets that are not smaller.

    A pair comes out under three keys at most: two elements of the first class, in the order of the smaller set, that
    both prefixes have, elements of the first two such classes, and the list of the first one. If any key of the pair is
    marked ``upwards``, one of these is. Pairs of which a prefix is too long to carry along come out under each key.
    """
    few = F.size("classes") <= CARRIED
    own = prefix.select("doc_id", F.when(few, F.col("classes")).alias("e"), F.slice(
        "classes", F.lit(1), F.size(F.filter("firsts", lambda k: k < F.col("single")))).alias("s"))
    rows = open_.join(own, "doc_id")
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("n", "shared", "comp", "e", "s")], F.col("doc_id").alias("b"))
    most = F.least("shared", "shared_b", "n", "n_b")
    both, listed = F.array_intersect("e", "e_b"), F.array_intersect("s", "s_b")
    one, two = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    first = F.array(
        F.when(F.size(both) > 0, _subset_key(one, one)), F.when(F.size(both) > 1, _subset_key(one, two)),
        F.when(F.size(listed) > 0, _list_key(F.get(listed, F.lit(0)))),
    )
    long = F.col("e").isNull() | F.col("e_b").isNull()
    return rows.filter("upwards").join(other, "key").filter(
        (F.struct("n", "doc_id") < F.struct("n_b", "b")) & (F.col("comp") != F.col("comp_b"))
        & (100 * most >= percent * (F.col("n") + F.col("n_b") - most)) & (long | F.exists(first, lambda k: F.col("key").eqNullSafe(k)))
    )


def _clustered(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), whose ids are unique."""
    sets, batches = likely_sets(docs, words, percent)
    first = stage(
        sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")),
        "distinct",
    )
    chosen = first.select(F.col("first").alias("doc_id"), batch_of("first", batches).alias("batch"))
    prefix = prefixes(sets, chosen, batches, percent)
    found = link(prefix, boundary(prefix, percent), sets, batches, percent)
    named = sets.select("doc_id", "n", "digest").join(first.filter("m > 1").select("digest", "first"), "digest", "left")
    named = named.withColumn("first", F.coalesce("first", "doc_id"))
    return named.join(found, F.col("first") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id")
    )


def _unique(docs: DataFrame) -> bool:
    """Whether no id is null or repeated."""
    seen = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1 OR doc_id IS NULL")
    return seen.isEmpty()


def _numbered(docs: DataFrame) -> DataFrame:
    """The stored rows with ``number_``: unique, and in the order of doc_id, null last."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    kept = stage(docs.withColumn("row_", F.struct(F.monotonically_increasing_id().alias("at"), digest.alias("digest"))), "rows")
    order = kept.select(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("row_.at").alias("at"), F.lit(0).alias("all"))
    numbers = enumerate_rows(order, ["all"], ["last", "doc_id", "at"], name="number_").select("at", "number_")
    return kept.join(numbers, F.col("row_.at") == F.col("at")).drop("row_", "at")


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if _unique(docs):
        return _clustered(docs, words, percent)
    rows = stage(_numbered(docs), "numbered")
    found = _clustered(rows.select(F.col("number_").alias("doc_id"), "text"), words, percent)
    ids = rows.select("number_", "doc_id")
    named = ids.join(found.withColumnRenamed("doc_id", "number_"), "number_")
    least = ids.select(F.col("number_").alias("component_id"), F.col("doc_id").alias("least_"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least_").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of every component that with the smallest doc_id (null last).

    Of rows with one id that belong together, any one stays.
    """
    if _unique(docs):
        dropped = cluster(docs, words, percent).filter("doc_id <> component_id").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    rows = stage(_numbered(docs), "numbered")
    found = _clustered(rows.select(F.col("number_").alias("doc_id"), "text"), words, percent)
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("number_"))
    return rows.join(dropped, "number_", "left_anti").select(*docs.columns)


@query("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    return cluster(table(spark, sf_dir, "documents"))
