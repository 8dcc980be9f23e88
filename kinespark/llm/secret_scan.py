"""Secret scan with a random forest that removes false positives.

Candidates are the values of at least 6 characters that are assigned to a name of the sort "token" or
"password", with all their punctuation, and all other runs of at least 16 key-like characters, cut at = and :
behind a name. A finding is described by its
length, character transitions (likelihood under the letter pairs of ordinary words, changes between
letters, digits and signs, entropy), dictionary coverage, path (the document's source) and
neighbouring words. The forest is trained on labelled findings whose kind is known because they were planted
(``planted_findings``): random keys and passwords, letters alone included, and false positives such as words, numbers,
addresses, paths, calls and placeholders behind the same names. No label is derived from what the features describe;
``label_finding``, a rule of thumb, is kept beside it for comparison only.
Words and letter pairs are counted over all documents. Tasks get LOOKUP of each: those that are most
frequent in relation to all of a language, for the language where that is most, so that rare languages
keep their words. The forest is fitted on FIT_FINDINGS planted findings; every candidate of every document is scored.

Defined results: null and empty texts have no findings; repeated rows are scanned each; a null source
is a path of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm.common import query, table, words
from kinespark.llm.planted_findings import planted
from kinespark.session import stage

FIT_FINDINGS = 12_000
LOOKUP = 50_000
COMMON_WORDS = 300
TREES, DEPTH = 40, 12
PATHS = 32  # buckets of sources

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@:-]{16,}")
# Parts of names that hold secrets, and of addresses.
NAMES = re.compile(r"(?i)(token|secret|passw(or)?d|passphrase|\bpass\b|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)")
NAME = r"(?:token|secret|passw(?:or)?d|passphrase|\bpass|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
# A value goes to its quote, or to a blank, bracket of a tag, quote, separator of lists or next parameter of an address.
ASSIGNMENT = re.compile(
    NAME + r"[\w.-]{0,40}[\"'\]]{0,2}[ \t]*(?:=>|:=|==?|:(?!//))[ \t]*(?:(?:bearer|basic)[ \t]+)?"
    r"(?:\"(?P<double>(?:\\.|[^\"\\\r\n]){6,})\"|'(?P<single>(?:\\.|[^'\\\r\n]){6,})'"
    r"|(?P<bare>(?:(?!&[\w.-]+=)[^\s\"'<>,;]){6,}))", re.IGNORECASE,
)
LEADING = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*(?:=|:(?!//))+")
LEAST_RUN = 16
ADDRESS = re.compile(r"(?i)@[a-z0-9-]+\.|^https?:|^www\.|\.(com|org|net|html?)$")
ASSIGNED = re.compile(r"[\w\"'\]]\s*(=|:|=>)\s*((?i:bearer|basic)\s+)?[\"']?$")
SIGNS = re.compile(r"[!#$%&*?^~+@]")

FEATURES = [
    "length", "pair_likelihood", "class_changes", "entropy", "digits", "capitals", "signs", "coverage", "path",
    "quoted", "assigned", "before_common", "after_common", "position",
]
FINDINGS = "doc_id string, start long, length int, digest string, label int, " + ", ".join(f"f_{x} double" for x in FEATURES)


def label_finding(value: str, before: str) -> int | None:
    """1 secret, 0 none, null undecided; from the name it is assigned to and its kind of characters."""
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if not letters or ADDRESS.search(value):
        return 0
    if NAMES.search(before) and ASSIGNED.search(before) and (digits or SIGNS.search(value)):
        return None if "(" in value else 1  # calls that give a secret are none
    return 0 if not digits else None


def _runs(text: str, at: int, end: int) -> Iterator[tuple[int, str]]:
    for found in CANDIDATE.finditer(text, at, end):
        start, stop = found.span()
        while start < stop:
            name = LEADING.match(text, start, stop)
            cut = name.end() if name else stop
            part = text[start:cut]
            value = part.strip(".:-=")
            if len(value) >= LEAST_RUN:
                yield start + part.find(value), value
            start = cut


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of the assigned values, and of the long runs between them, from left to right."""
    at = look = 0
    while found := ASSIGNMENT.search(text, look):
        kind = found.lastgroup
        start, end = found.span(kind)
        if kind == "bare":
            # "password: token=abc" assigns abc only
            while (name := LEADING.match(text, start, end)) and end - name.end() >= 6:
                start = name.end()
            end = start + len(text[start:end].rstrip(".:)]}"))
        look = found.end()
        if end - start >= 6:
            yield from _runs(text, at, start)
            yield start, text[start:end]
            at = end
    yield from _runs(text, at, len(text))


class Describer:
    def __init__(self, pairs: dict[tuple[str, str], float], dictionary: list[str], common: set[str]):
        self.pairs, self.common = pairs, common
        self.rare = min(pairs.values(), default=-10.0) - 1.0
        self.words = {w for w in dictionary if len(w) >= 3}
        self.sizes = sorted({len(w) for w in self.words}, reverse=True)

    def coverage(self, value: str) -> float:
        """Share of the characters that dictionary words cover, longest word first from the left."""
        at = covered = 0
        while at < len(value):
            size = next((k for k in self.sizes if value[at : at + k] in self.words and at + k <= len(value)), 0)
            covered += size
            at += size or 1
        return covered / len(value)

    def features(self, value: str, before: str, after: str, source: str | None, position: float) -> list[float]:
        small, n = value.lower(), len(value)
        kinds = np.array([0 if c.isalpha() else 1 if c.isdigit() else 2 for c in value])
        counts = np.array([value.count(c) for c in set(value)]) / n
        likelihood = sum(self.pairs.get(p, self.rare) for p in zip(small, small[1:])) / max(1, n - 1)
        last = re.findall(r"\w+", before.lower())[-1:]
        following = re.findall(r"\w+", after.lower())[:1]
        return [
            math.log(n), likelihood, float(np.count_nonzero(np.diff(kinds))) / n, float(-(counts * np.log2(counts)).sum()),
            float((kinds == 1).mean()), sum(c.isupper() for c in value) / n, float((kinds == 2).mean()),
            self.coverage(small), float(zlib.crc32((source or "").encode()) % PATHS),
            float(before[-1:] in "\"'" and before != ""), float(bool(ASSIGNED.search(before))),
            float(bool(last) and last[0] in self.common), float(bool(following) and following[0] in self.common), position,
        ]


def _top(counted: DataFrame, what: str) -> list:
    """(what, n) of the LOOKUP entries with the largest share of a language's counts; ties by count and name."""
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counted.join(totals, "lang").groupBy(what).agg(F.sum("n").alias("n"), F.max(F.col("n") / F.col("all")).alias("share"))
    return shares.orderBy(F.desc("share"), F.desc("n"), what).limit(LOOKUP).select(what, "n").collect()


def fit_tables(docs: DataFrame, labels: DataFrame | None = None) -> Describer:
    """Letter pairs and words of all documents; labels are not read. Without a column lang all are one language."""
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    raw = docs.select(lang.alias("lang"), F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = stage(
        raw.withColumn("word", F.regexp_extract("word", r"^\p{L}+", 0)).filter("word <> ''")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words",
    )
    frequent = _top(counted, "word")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    pairs = stage(
        counted.filter("length(word) > 1").select("lang", pair.alias("pair"), "n").groupBy("lang", "pair").agg(F.sum("n").alias("n")),
        "pairs",
    )
    top = _top(pairs, "pair")
    firsts: dict[str, int] = {}
    for p, n in top:
        firsts[p[0]] = firsts.get(p[0], 0) + n
    by_count = sorted(frequent, key=lambda r: (-r["n"], r["word"]))
    return Describer(
        {(p[0], p[1]): math.log(n / firsts[p[0]]) for p, n in top}, [r["word"] for r in frequent],
        {r["word"] for r in by_count[:COMMON_WORDS]},
    )


def findings(docs: DataFrame, describer: Describer) -> DataFrame:
    """All candidates of docs (doc_id, text, source) with features and, where it says something, the rule's label."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FINDINGS.split(", ")]
        for frame in frames:
            rows = []
            for doc, text, source in frame.itertuples(index=False):
                for start, value in candidates(text) if isinstance(text, str) else ():
                    before, after = text[max(0, start - 40) : start], text[start + len(value) : start + len(value) + 40]
                    source = source if isinstance(source, str) else None
                    rows.append((
                        doc, start, len(value), hashlib.sha256(value.encode()).hexdigest(), label_finding(value, before),
                        *describer.features(value, before, after, source, start / len(text)),
                    ))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"label": "Int32"})

    # ids go through pandas as text, which keeps their digits beside nulls
    found = docs.select(F.col("doc_id").cast("string"), "text", "source").mapInPandas(run, FINDINGS)
    return stage(found.withColumn("doc_id", F.col("doc_id").cast("long")), "findings")


def labelled(spark: SparkSession, describer: Describer, count: int = FIT_FINDINGS, seed: int = 7) -> DataFrame:
    """Planted findings of both kinds in equal numbers, with the features of FINDINGS."""
    rng = random.Random(seed)
    rows = []
    for text, start, length, label in planted(describer.words, count // 2, seed):
        value, before = text[start : start + length], text[max(0, start - 40) : start]
        after = text[start + length : start + length + 40]
        # a planted text is a piece of some document of some source
        found = describer.features(value, before, after, str(rng.randrange(10**6)), rng.random())
        rows.append((label, *map(float, found)))
    return spark.createDataFrame(rows, "label int, " + ", ".join(f"f_{x} double" for x in FEATURES))


def train(spark: SparkSession, describer: Describer, seed: int = 7):
    """A forest on planted findings."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8
    )
    return forest.fit(assemble(stage(labelled(spark, describer, seed=seed), "labelled")))


def assemble(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="features").transform(found)


def score(found: DataFrame, forest) -> DataFrame:
    """Add score (share of the forest that takes it for a secret) and is_secret."""
    scored = forest.transform(assemble(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, start (in code points), length, digest, score, is_secret of every finding."""
    describer = fit_tables(docs, labels)
    forest = train(docs.sparkSession, describer)
    return score(findings(docs, describer), forest).select("doc_id", "start", "length", "digest", "score", "is_secret")


@query("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
