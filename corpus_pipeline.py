"""Corpus preparation: stages applied to documents one after another, each written and read again.

Every stage works on all that the one before kept and returns the columns of
documents, but for the last, which returns pieces of packed sequences. Rows
without doc_id are left out by the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentscope.llm import common, exact_dedup, language_id, ngram_join, packing, quality_rules

#: Words that a worker remembers in the last stage, which shares its executors with what the others left.
WORDS_KEPT = 150_000


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised stay; text without a letter goes, and what scores too low.

    If no labelled document can be learned from, all with a letter stay.
    """
    common.configured(spark)
    return language_id.recognised(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that their host repeats are removed; documents that are little else go, and those that fail the base rules."""
    common.configured(spark)
    return quality_rules.passing(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the smallest doc_id stays, one row of it."""
    common.configured(spark)
    return exact_dedup.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect (shingles of five words, a similarity of 0.8) the smallest doc_id stays."""
    common.configured(spark)
    return ngram_join.without_near_duplicates(docs, gram=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 1024 ids."""
    common.configured(spark)
    return packing.byte_packing(docs, kept=WORDS_KEPT)


STAGES = [
    ("language_id", recognise_language),
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: Learned languages and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
