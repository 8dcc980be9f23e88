"""Null, repeated and large ids and columns with clashing names, through every operator, stage and the pipeline."""

import hashlib
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinespark.llm import exact_dedup, jaccard_join, mixing, pieces, quality_model, secret_scan, suffix_dedup, token_counts

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, rate string, target string, copies string,"
    " copy string, source_ string, row string, id string, batch string, key string"
)
EXTRA = ("size", "rate", "target", "copies", "copy", "source_", "row", "id", "batch", "key")
BIG = 2**53 + 1


def hard_rows():
    rng = random.Random(11)
    words = [f"word{k}" for k in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, other, lone = prose(90), prose(60), prose(70)
    near = base.replace(base.split(" ")[40], "edited", 1)
    rows = [
        (None, None), (None, ""), (None, lone), (None, base), (BIG, base.upper()), (BIG + 2, near), (5, prose(50)), (5, other), (5, other),
        (9, other.upper()), (-3, prose(40) + ' password = "kq7!zz9"'), (7, "unique text of seven"), (7, "another text of seven"),
        (11, lone + " "), (None, prose(30)), (12, prose(30)),
    ]
    return [(d, t, "en", f"s{k % 3}", 1, *EXTRA) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def hard(spark):
    # few partitions, so that null ids and large ones meet in one batch
    return hard_rows(), spark.createDataFrame(hard_rows(), COLUMNS).coalesce(2)


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ids_come_out_as_they_went_in(hard):
    rows, frame = hard
    ids = Counter(r[0] for r in rows)
    for run in (token_counts.count_tokens, suffix_dedup.repeated_spans, exact_dedup.label, jaccard_join.cluster, mixing.mix, pieces.encode):
        assert Counter(r[0] for r in run(frame).select("doc_id").collect()) == ids, run
    found = secret_scan.findings(frame, secret_scan.fit_tables(frame, frame.select("doc_id", F.lit(1).alias("quality"))))
    assert {r[0] for r in found.select("doc_id").collect()} <= set(ids)


def test_repeated_strings_and_sums_of_rows_with_any_id(hard):
    rows, frame = hard
    got = plain(suffix_dedup.repeated_spans(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeated_strings([r[:2] for r in rows])


def test_exact_dedup_of_rows_with_any_id(hard):
    rows, frame = hard
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(brute.SMALL), []).append(d)
    expected = []
    for d, t, *_ in rows:
        own = groups[(t or "").translate(brute.SMALL)]
        keep = max((x for x in own if x is not None), default=None)
        sha = hashlib.sha256((t or "").translate(brute.SMALL).encode()).hexdigest()
        expected.append((d, keep, len(own), d == keep, sha))
    assert plain(exact_dedup.label(frame), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)
    stays = exact_dedup.keep_first(frame)
    assert stays.columns == frame.columns
    kept = stays.collect()
    assert sorted((r["text"] or "").translate(brute.SMALL) for r in kept) == sorted(groups)
    assert all(r["doc_id"] == max((x for x in groups[(r["text"] or "").translate(brute.SMALL)] if x is not None), default=None) for r in kept)
    assert all(tuple(r) in set(rows) for r in kept)


def test_jaccard_join_of_rows_with_any_id(hard):
    rows, frame = hard
    numbered = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    found = brute.components([(n, rows[k][1]) for n, k in enumerate(numbered)])
    expected = sorted(((rows[numbered[n]][0], size, rows[numbered[c]][0]) for n, size, c in found), key=repr)
    assert plain(jaccard_join.cluster(frame), "doc_id", "n_shingles", "component_id") == expected
    stays = jaccard_join.keep_one(frame)
    assert stays.columns == frame.columns and stays.count() == sum(n == c for n, _, c in found)
    assert all(tuple(r) in set(rows) for r in stays.collect())


def test_mixture_leaves_all_columns_as_they_are(hard):
    rows, frame = hard
    emitted = mixing.emit(frame)
    assert emitted.columns == frame.columns
    taken = Counter(tuple(r) for r in emitted.collect())
    assert set(taken) <= set(rows)
    copies = Counter()
    for r in mixing.mix(frame).collect():
        copies[(r["doc_id"], r["source"])] += r["copies"]
    by_source = Counter()
    for r, n in taken.items():
        by_source[(r[0], r[3])] += n
    assert by_source == +copies


def test_classifier_judges_every_row_by_its_text(spark, hard):
    rows, frame = hard
    labels = spark.createDataFrame([(9, 1, 0), (12, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(frame, labels)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)
    kept = quality_model.keep_good(frame, labels)
    assert kept.columns == frame.columns
    stays = Counter(tuple(r) for r in kept.collect())
    assert sum(stays.values()) == got.filter("kept").count() and not [r for r in stays if not r[1]]
    assert set(stays) <= set(rows)


def test_the_pipeline_keeps_columns_and_needs_no_rows(spark, hard, tmp_path):
    rows, frame = hard
    labels = spark.createDataFrame([(9, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("hard", frame), ("nothing", frame.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == [*frame.columns, "ids", "n_tokens", "round_trip"]
        got = [tuple(r)[: len(frame.columns)] for r in out.collect()]
        assert set(got) <= set(rows) and bool(got) == (name == "hard")
