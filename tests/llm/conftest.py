import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, batch string"


def awkward_texts():
    """Nulls, empty, blank and very long texts, ties, repeated rows, exact and near copies."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "é", "ßx", "omega", "the", "of", "and", "zeta", "kappa", "lambda"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "."]) for _ in range(n))

    base, passage = prose(120), prose(60)
    near = base.split(" ")
    near[7] = "edited"
    long = prose(9_000)
    return [
        None, "", " \t\n", "x", "one two three", "one two three", "ONE two three", base, base, base.upper(), " ".join(near),
        prose(40) + " " + passage + " " + prose(50), passage, passage + "\n" + passage, "a" * 700, "ab " * 300,
        long, long + " end", "line\nline\nline\n\n", prose(300), "\x0b\x0c\r word word", "🙂 " * 90, "token = \"abc\"",
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """(rows, frame): the texts with clashing extra columns, a null id, a repeated row and null sources."""
    rows = []
    for k, text in enumerate(awkward_texts()):
        rows.append((k, text, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 5}", 1, "size", "key", "batch"))
    rows.append(rows[8])
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in (7, 11, 19)] + [(16, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def awkward_dir(spark, awkward, labels, tmp_path_factory):
    """The same rows as a folder of tables, for queries and their SQL."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    html = [t for _, t, *_ in awkward[0]]
    pages = [(k, None if k % 4 == 0 else f"http://Www.Example.com:80/{k % 3}?q#f", t) for k, t in enumerate(html)]
    awkward[1].write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    turns = [(k % 13 - 3, None if k % 5 == 0 else k % 4, None if k % 6 == 0 else "user", t) for k, t in enumerate(html * 3)]
    turns += [(None, 0, "user", "x"), (2**53 + 1, 0, "user", "y"), (2**53 + 3, 0, "user", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder
