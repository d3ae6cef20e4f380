"""Corpus pipeline: quality classifier, quality rules, line deduplication, near duplicates, packing.

Each stage works on all that its predecessor kept, which is written as a table and read again. Stages that filter return the columns of
``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlight.llm import line_templates, ngram_join, packing, quality, rules
from barlight.llm.common import small_batches
from barlight.llm.queries import VOCABULARY
from barlight.session import durable
from barlight.sources.derived import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    small_batches(spark)
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    small_batches(spark)
    return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents; n_chars counts what is left."""
    left = line_templates.drop_recurring_lines(docs)
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return ngram_join.first_of_each(docs, width=5, percent=80)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("sequence_packing", sequence_packing),
]

ORACLE_SQL = None
"""Fitted models, templates and packing are beyond SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
