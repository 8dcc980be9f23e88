"""The Kneser-Ney classifier against a plain-Python model: counts, discounts, probabilities, perplexities and thresholds."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.llm import quality_model

ORDER = quality_model.ORDER


def plain_model(texts):
    """{order: {gram: count}}, {order: (d1, d2, d3)} and the function gram → probability."""
    tables = {ORDER: Counter()}
    for t in texts:
        data = b"\n" * (ORDER - 1) + t
        tables[ORDER].update(data[i : i + ORDER] for i in range(len(data) - ORDER + 1))
    for m in range(ORDER - 1, 0, -1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])
    cuts, totals, weights = {}, {}, {}
    for m, table in tables.items():
        n1, n2, n3, n4 = (max(sum(n == k for n in table.values()), 1) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cuts[m] = tuple(min(max(d, 0.1), k - 0.1) for d, k in zip(raw, (1, 2, 3)))
        totals[m], taken = Counter(), defaultdict(float)
        for g, n in table.items():
            totals[m][g[:-1]] += n
            taken[g[:-1]] += cuts[m][min(n, 3) - 1]
        weights[m] = {c: taken[c] / n for c, n in totals[m].items()}

    def probability(gram):
        m = len(gram)
        if m == 0:
            return 1 / 256
        lower, context = probability(gram[1:]), gram[:-1]
        if context not in totals[m]:
            return lower
        n = tables[m].get(gram, 0)
        own = (n - cuts[m][min(n, 3) - 1]) / totals[m][context] if n else 0.0
        return own + weights[m][context] * lower

    return tables, cuts, probability


def prose(rng, alphabet, size):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(size))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(17)
    rows = []
    for k in range(260):
        lang = "en" if k % 3 else "xx" if k % 2 else None
        alphabet = "etaoinshrdlu" if k % 3 else "äöüßqwertz"
        text = prose(rng, alphabet, rng.randint(5, 60)) if k % 20 else "".join(chr(rng.randint(33, 122)) for _ in range(200))
        rows.append((k, text, lang))
    rows += [(300, "", "en"), (301, None, None), (302, "x", "en"), (303, "a\n\nb" * 30, "yy")]
    labels = [(k, 0 if k % 20 == 0 else 1, 0) for k in range(0, 260) if k % 7]
    return (rows, spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_counts_discounts_and_probabilities(spark, corpus):
    rows, docs, _ = corpus
    texts = [t.encode() for d, t, _ in rows[:60]]
    tables, cuts, probability = plain_model(texts)
    counted = quality_model.count_grams(docs.filter("doc_id < 60"))
    assert {r["gram"].to_bytes(ORDER, "big"): r["n"] for r in counted.collect()} == tables[ORDER]
    assert quality_model.discounts(counted) == pytest.approx(cuts[ORDER])
    model = quality_model.fit(counted)
    rng = random.Random(2)
    seen = rng.sample(sorted(tables[ORDER]), 150)
    mixed = [g[:-1] + bytes([rng.randrange(256)]) for g in seen] + [bytes(rng.choices(range(256), k=ORDER)) for _ in range(60)]
    asked = {int.from_bytes(g, "big"): g for g in seen + mixed}
    got = quality_model.probabilities(spark.createDataFrame([(k,) for k in asked], "gram long"), model).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r["p"] == pytest.approx(probability(asked[r["gram"]]), rel=1e-9)


def test_perplexities_and_thresholds(corpus):
    rows, docs, labels = corpus
    found = {r["doc_id"]: r for r in quality_model.classify(docs, labels).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    unseen = {r[0] for r in docs.filter(quality_model.unseen()).select("doc_id").collect()}
    _, _, probability = plain_model([t.encode() for d, t, _ in rows if d in good - unseen])
    expected = {}
    for d, t, _ in rows:
        data = b"\n" * (ORDER - 1) + (t or "").encode()
        logs = [math.log(probability(data[i : i + ORDER])) for i in range(len(data) - ORDER + 1)]
        expected[d] = math.exp(-sum(logs) / len(logs)) if logs else None
        assert found[d]["perplexity"] == (pytest.approx(expected[d], rel=1e-4) if logs else None)

    def cuts(docs_):
        def at(values, share):
            return sorted(values)[max(0, math.ceil(share * len(values)) - 1)] if values else None
        own = [found[d]["perplexity"] for d in docs_]
        new = [found[d]["perplexity"] for d in docs_ if d in unseen]
        return at(own, quality_model.LOW), at(new, quality_model.HIGH) or at(own, quality_model.HIGH)

    by_lang = defaultdict(list)
    for d, _, lang in rows:
        if d in good:
            by_lang[lang].append(d)
    overall = cuts(sorted(good))
    used = set()
    for d, _, lang in rows:
        own = by_lang.get(lang, [])
        enough = sum(x in unseen for x in own) >= quality_model.ENOUGH
        used.add(enough)
        low, high = cuts(own) if enough else overall
        assert found[d]["low"] == pytest.approx(low / quality_model.MARGIN) and found[d]["high"] == pytest.approx(high * quality_model.MARGIN)
        p = found[d]["perplexity"]
        assert found[d]["kept"] == (p is not None and low / quality_model.MARGIN <= p <= high * quality_model.MARGIN)
    assert used == {True, False}
    noise = [d for d, _, _ in rows if d < 260 and d % 20 == 0]
    assert not any(found[d]["kept"] for d in noise)


def test_model_is_fitted_on_the_whole_training_half(corpus, monkeypatch):
    _, docs, labels = corpus
    counted, count_grams = [], quality_model.count_grams
    monkeypatch.setattr(quality_model, "TRUSTED_LIMIT", 5, raising=False)
    monkeypatch.setattr(quality_model, "count_grams", lambda d: counted.append(d.count()) or count_grams(d))
    quality_model.judge(docs, labels)
    assert counted == [quality_model.trusted_ids(labels).filter(~quality_model.unseen()).count()]


def test_grams_of_each_text_and_their_memory():
    rng = random.Random(5)
    texts = [b"", *(prose(rng, "abcd \n\u00e9", rng.randint(0, 9)).encode() for _ in range(50)), b"", b"x", b""]
    found, owner = quality_model.grams(texts)
    plain = [
        (int.from_bytes((b"\n" * (ORDER - 1) + t)[i : i + ORDER], "big"), k) for k, t in enumerate(texts) for i in range(len(t))
    ]
    assert list(zip(found.tolist(), owner.tolist())) == plain and found.dtype == np.uint64
    assert [len(x) for x in quality_model.grams([b""])] == [0, 0]
    texts = [b"some words of a text " * 500] * 100
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        quality_model.grams(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * size  # 48 times with whole arrays of positions and of bytes as integers
