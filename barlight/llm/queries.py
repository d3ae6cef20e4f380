"""Registered queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barlight.llm import alignment, bpe, language, licenses, line_templates, ngram_join, packing, quality, rules, topk, toxicity, warc, whitening
from barlight.llm.oracles import ORACLE_SQL  # noqa: F401 - read by __spark_entry__
from barlight.sources.derived import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, BYTE_RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and of the decoded text."""
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, keep_ids=False, keep_text=False)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned by weak supervision."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices that documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.ALL_NOTICES)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of templates that recur across documents."""
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule cascade for every document."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned by co-training."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing entropy."""
    return language.identify(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two vocabularies in every document, with their counts over all documents."""
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, BYTE_RANKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_line_templates": op6_line_templates,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc_archives": op8_warc_archives,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sequence_packing": op10_sequence_packing,
    "op11_language_id": op11_language_id,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
