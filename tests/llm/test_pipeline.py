"""The pipeline's stages against plain Python, each on its own input."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from kinespark.llm import mixing, quality_model
from kinespark.session import stage


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, sf_dir))
        seen[name] = (before, docs)
        assert name == "SentencePiece" or docs.columns == columns

    before, after = seen["quality classifier"]
    kept = {r[0] for r in rows_of(quality_model.classify(before, labels).filter("kept"), "doc_id")}
    assert {r[0] for r in rows_of(after, "doc_id")} == kept and len(kept) > 0.8 * before.count()

    before, after = seen["exact dedup"]
    last = {}
    for doc, text in sorted(rows_of(before, "doc_id", "text")):
        last[(text or "").translate(brute.SMALL)] = doc
    assert sorted(r[0] for r in rows_of(after, "doc_id")) == sorted(last.values())

    before, after = seen["n-gram Jaccard join"]
    stay = sorted(d for d, _, c in brute.components(rows_of(before, "doc_id", "text"), 80, 5) if c == d)
    assert sorted(r[0] for r in rows_of(after, "doc_id")) == stay

    before, after = seen["mixing"]
    copies = {r[0]: r[1] for r in rows_of(mixing.mix(before), "doc_id", "copies")}
    assert sorted(r[0] for r in rows_of(after, "doc_id")) == sorted(d for d, n in copies.items() for _ in range(n))

    before, after = seen["SentencePiece"]
    assert after.count() == before.count() and after.filter(~F.col("round_trip") | (F.size("ids") != F.col("n_tokens"))).count() == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    assert {"ids", "n_tokens", "doc_id", "text"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_near_copies_of_four_fifths_of_five_words_go(spark, sf_dir):
    base = [f"w{k}" for k in range(104)]
    # (words added behind 100 shingles of 5 words, whether the longer one is linked)
    cases = [(0, True), (20, True), (25, True), (26, False), (40, False)]
    rows = []
    for k, (more, _) in enumerate(cases):
        text = [f"c{k}{w}" for w in base]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + [f"m{k}x{j}" for j in range(more)]))]
    # an edited word spoils five shingles: 2 of 104 words leave 90 of 110, 3 leave 85 of 115
    for k, edits in ((20, 2), (22, 3)):
        text = [f"c{k}{w}" for w in base]
        rows += [(k, " ".join(text)), (k + 1, " ".join("edited" if j in range(20, 20 + 30 * edits, 30) else w for j, w in enumerate(text)))]
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    linked = {2 * k + 1 for k, (_, same) in enumerate(cases) if same} | {21}
    assert sorted(r[0] for r in rows_of(got, "doc_id")) == sorted(d for d, _ in rows if d not in linked)
