"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Each stage works on what its predecessor kept, written as Parquet and read
again. All stages but the last return the columns of ``documents``; the last
one returns the mixture: id, tokens, domain posterior, rate and copies of every
document with a rate over 0.

All stages take nulls in any column, empty and very long texts (whole), rows
that repeat an id, ids of any type with an order, and empty tables, which stay
empty. Rows without an id are kept unless their own text speaks against them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from veilspark.llm.queries import MIX_WEIGHTS, domains_of
from veilspark.llm.stage import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; the model is fitted on the labelled rows among ``docs``.

    Null and empty texts have the score of a text without lines. Without labels
    every document scores 0.5 and stays. Equal texts have equal scores.
    """
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.3)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars follows the text.

    No document goes: one that loses all its lines has an empty text, and so has
    one with a null text. Rows that repeat an id count as one document.
    """
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-shingles at Jaccard 0.8: the one with the smallest id.

    Texts without words are linked with nothing and stay, as do rows without an
    id. Rows that repeat an id are one document and stay or go together.
    """
    return ngram_join.one_per_group(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of a benchmark item, with at most a fifth of its words edited.

    Items and texts without words match nothing, so that empty documents stay;
    without items all stay.
    """
    return decontaminate.drop_leaking(docs, _table(spark, sf_dir, "benchmark"), rate=0.2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for the target weights; documents with rate 0 are not in the mixture.

    Empty texts have 0 tokens and the rate of their posterior. Without labels
    every document has the rate 1. Rows that repeat an id have rates of their own.
    """
    return mixing.mix(docs, domains_of(_table(spark, sf_dir, "labels")), "domain", MIX_WEIGHTS).where("rate > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifiers are fitted, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when its successor is written."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        scratch.release()
        before = docs
    return docs
