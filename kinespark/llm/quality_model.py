"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams.

The model is fitted on one half, by a hash of the id, of the trusted documents (labelled good and not
toxic), on the whole of that half. Its counts, discounts, back-off weights and probabilities are tables made by
joins and group-bys, one row per n-gram.

Scoring gathers from all documents: every batch of documents lists its distinct n-grams, the lists
are dealt to shards, each shard's distinct n-grams are joined with the model order by order, and the
shard answers every batch with the log-probabilities of its n-grams. A document's perplexity is then
a sum of look-ups over its whole text. Thresholds are quantiles by language: the upper one of the
trusted documents that the model has not seen, the lower one of all trusted documents. A document outside
of them is rejected.

Defined results: null and empty texts have no perplexity and are rejected; a language (null included)
with fewer than ``ENOUGH`` held-out documents takes the quantiles over all languages; without any
trusted document nothing but empty texts is rejected; repeated rows are scored alike; rows with one or
no doc_id are judged each by its own text; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import batch_count, batch_of, give_back, query, release, shard_count, stage_bucketed, table
from kinespark.llm.suffix_dedup import chunks
from kinespark.session import stage

ORDER = 5
LOW, HIGH = 0.002, 0.995  # quantiles of the trusted perplexities
MARGIN = 1.02  # beyond the quantiles
ENOUGH = 30


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte (packed, first byte highest) and the number of its text.

    A text is taken to follow ORDER - 1 line ends.
    """
    lead = b"\n" * (ORDER - 1)
    data = np.frombuffer(lead.join([b"", *texts]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    packed = np.zeros(max(0, len(data) - (ORDER - 1)), np.uint64)
    for k in range(ORDER):  # in place: arrays of 8 bytes a byte of text are what a task's memory goes to
        packed <<= np.uint64(8)
        packed |= data[k : k + len(packed)]
    inside = np.repeat(np.resize([True, False], 2 * len(texts)), np.c_[lengths, np.full(len(texts), ORDER - 1)].ravel())
    packed = packed[inside[: len(packed)]]
    return packed, np.repeat(np.arange(len(texts)), lengths)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, count) over all texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for frame in frames:
            for _, texts in chunks(frame["text"]):
                keys, counts = np.unique(grams(texts)[0], return_counts=True)
                yield pd.DataFrame({"gram": keys.astype(np.int64), "n": counts})

    return docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _low(gram: str | Column, bytes_: int) -> Column:
    return F.expr(f"{gram} & {256**bytes_ - 1}L") if bytes_ else F.lit(0).cast("long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts."""
    found = counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (max(float(x or 0), 1.0) for x in found)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k - 0.1) for d, k in zip(raw, (1, 2, 3)))


def fit(counted: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order: probabilities (gram, p) and back-off weights (context, gamma).

    The highest order has the counts themselves, every lower one the number of different bytes
    that precede the n-gram.
    """
    tables = {ORDER: stage(counted, "grams")}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = stage(tables[m + 1].groupBy(_low("gram", m).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for m in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[m])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = tables[m].withColumn("context", F.shiftright("gram", 8)).withColumn("cut", cut)
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        rows = rows.join(contexts, "context").withColumn("low", _low("gram", m - 1))
        if m == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.join(model[m - 1][0].select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")
        model[m] = (stage(rows.select("gram", p.alias("p")), "p"), stage(contexts.select("context", "gamma"), "gamma"))
    return model


def probabilities(asked: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of asked (gram): the model's where it knows the n-gram, else weight times the lower order's."""
    wanted = {ORDER: asked}
    for m in range(ORDER - 1, 0, -1):
        wanted[m] = stage(wanted[m + 1].select(_low("gram", m).alias("gram")).distinct(), "wanted")
    below = None
    for m in range(1, ORDER + 1):
        known, weights = model[m]
        rows = wanted[m].withColumn("context", F.shiftright("gram", 8)).withColumn("low", _low("gram", m - 1))
        rows = rows.join(known, "gram", "left").join(weights, "context", "left")
        lower = F.lit(1 / 256)
        if below is not None:
            rows = rows.join(below.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
            lower = F.col("below")
        p = F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * lower)
        below = stage(rows.select("gram", p.alias("p")), "asked")
    return below


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted n-grams as compressed differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), 1)


def widen(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint64), dtype=np.uint64)


PACKS = "batch int, ids array<string>, sizes array<int>, texts binary"


def pack_texts(docs: DataFrame, batches: int) -> DataFrame:
    """PACKS: the texts by batch (a hash of doc_id); those that one task has for a batch are compressed together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for frame in frames:
            rows = []
            for batch, some in frame.groupby("batch"):
                ids = some["doc_id"].tolist()
                for first, texts in chunks(some["text"]):
                    own = ids[first : first + len(texts)]
                    packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
                    rows.append((int(batch), own, [len(t) for t in texts], packed))
            yield pd.DataFrame(rows, columns=["batch", "ids", "sizes", "texts"])

    # ids as text: pandas would turn integers with nulls among them into floats
    named = docs.select(F.col("doc_id").cast("string"), "text", batch_of("doc_id", batches).alias("batch"))
    return named.mapInPandas(run, PACKS)


def unpack_texts(sizes: np.ndarray, texts: bytes) -> list[bytes]:
    data, ends = zstandard.ZstdDecompressor().decompress(texts), np.cumsum(sizes)
    return [data[e - n : e] for n, e in zip(sizes, ends)]


LISTS = "shard int, batch int, grams binary"
ANSWERS = "batch int, grams binary, logs binary"


def perplexities(docs: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, perplexity (per byte; null without text) of every row of docs (doc_id, text)."""
    spark, batches = docs.sparkSession, batch_count(docs)
    shards = shard_count(batches)
    # stored by batch: both passes over the texts read whole batches without a shuffle
    packs = stage_bucketed(pack_texts(docs, batches).repartition(batches, "batch"), batches, "packs")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        seen: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for batch, some in frame.groupby("batch"):
                held = seen.setdefault(int(batch), [])
                held += [np.unique(grams(unpack_texts(n, t))[0]) for n, t in zip(some["sizes"], some["texts"])]
                seen[int(batch)] = [np.unique(np.concatenate(held))]
        for batch, (keys,) in seen.items():
            shard = (keys % np.uint64(shards)).astype(np.int64)
            rows = [(s, batch, squeeze(keys[shard == s])) for s in np.unique(shard).tolist()]
            yield pd.DataFrame(rows, columns=["shard", "batch", "grams"])

    lists = stage(packs.select("batch", "sizes", "texts").mapInPandas(send, LISTS), "lists")
    release(spark)

    def distinct(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        found = np.unique(np.concatenate([widen(g) for g in rows["grams"]]))
        return pd.DataFrame({"gram": found.astype(np.int64)})

    asked = stage(lists.groupBy("shard").applyInPandas(distinct, "gram long"), "wanted")
    known = probabilities(asked, model).select(
        F.pmod("gram", F.lit(shards)).cast("int").alias("shard"), "gram", F.log("p").alias("log")
    )

    def answer(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        give_back()
        known = known.sort_values("gram")
        keys, logs = known["gram"].to_numpy().astype(np.uint64), known["log"].to_numpy(np.float32)
        out = [(b, g, logs[np.searchsorted(keys, widen(g))].tobytes()) for b, g in zip(rows["batch"], rows["grams"])]
        return pd.DataFrame(out, columns=["batch", "grams", "logs"])

    answers = lists.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(answer, ANSWERS)
    release(spark)

    def score(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "perplexity"])
        none = np.zeros(0)
        keys = np.concatenate([none.astype(np.uint64), *map(widen, found["grams"])])
        logs = np.concatenate([none.astype(np.float32), *[np.frombuffer(g, np.float32) for g in found["logs"]]])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order].astype(np.float64)
        out = []
        for sizes, packed in zip(rows["sizes"], rows["texts"]):
            texts = unpack_texts(sizes, packed)
            gram, owner = grams(texts)
            total = np.bincount(owner, logs[np.searchsorted(keys, gram)], len(texts)) if len(gram) else np.zeros(len(texts))
            out.append(np.where(sizes > 0, np.exp(-total / np.maximum(sizes, 1)), np.nan))
        return pd.DataFrame({"doc_id": [i for own in rows["ids"] for i in own], "perplexity": np.concatenate(out)})

    scored = packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "doc_id string, perplexity double")
    scored_value = F.when(~F.isnan("perplexity"), F.col("perplexity"))
    kind = dict(docs.dtypes)["doc_id"]
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), scored_value.alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def unseen() -> Column:
    """Whether a trusted document is held out for the thresholds."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, perplexity, low, high, kept of every row of docs (doc_id, text, lang)."""
    trusted = stage(trusted_ids(labels), "trusted")
    # ids grow with the labels: the optimizer broadcasts them only when the stored table is small
    model = fit(count_grams(docs.select("doc_id", "text").join(trusted.filter(~unseen()), "doc_id", "left_semi")))
    # what a row needs later travels with its text in place of the id, so rows without id or with a common one stay apart
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "lang", text_hash(F.col("text")).alias("text_hash"))
    tagged = docs.select(F.to_json(row).alias("doc_id"), "text")
    scores = perplexities(tagged, model).select(
        F.from_json("doc_id", "doc_id long, lang string, text_hash long").alias("row"), "perplexity"
    )
    named = stage(scores.select("row.*", "perplexity"), "scores")
    release(docs.sparkSession)
    good = named.join(trusted, "doc_id").filter("perplexity IS NOT NULL")
    new = F.when(unseen(), F.col("perplexity"))
    cuts = F.array(
        F.percentile_approx("perplexity", LOW, 10_000),
        F.coalesce(F.percentile_approx(new, HIGH, 10_000), F.percentile_approx("perplexity", HIGH, 10_000)),
    )
    overall = good.agg(cuts.alias("all_cuts"))
    by_lang = good.groupBy("lang").agg(cuts.alias("cuts"), F.count(new).alias("n")).filter(f"n >= {ENOUGH}")
    by_lang = by_lang.select(F.col("lang").alias("lang_"), "cuts")
    # one row per language, and one row
    judged = named.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(overall), how="left")
    cut = F.coalesce("cuts", "all_cuts")
    judged = judged.withColumns({"low": cut[0] / MARGIN, "high": cut[1] * MARGIN})
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.col("low").isNull())
    return judged.select(
        "doc_id", "lang", "text_hash", "perplexity", "low", "high", (F.col("perplexity").isNotNull() & inside).alias("kept")
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, low, high, kept of every row of docs (doc_id, text, lang)."""
    return judge(docs, labels).drop("text_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are not rejected, with all their columns."""
    bad = judge(docs, labels).filter("NOT kept").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))
    return rows.join(bad, same, "left_anti").select("row.*")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
