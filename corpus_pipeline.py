"""The corpus pipeline: five stages, each over all that its predecessor kept, stored between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import exact_dedup, jaccard_join, mixing, pieces, quality_model
from kinespark.llm.common import table
from kinespark.session import stage

NEAR_WORDS, NEAR_PERCENT = 5, 80  # shingles of the near-duplicate stage and the similarity that links them


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the quantiles of their language."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets, that with the smallest doc_id."""
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate wants it."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with ids, n_tokens and round_trip."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mixture),
    ("SentencePiece", tokens),
]

ORACLE_SQL = None  # perplexities and token ids have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
