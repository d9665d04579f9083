"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motorgrid.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from motorgrid.llm.common import settle, small_batches, table
from motorgrid.session import ship_package

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Shingles of five words. Fingerprints within 14 bits propose, a similarity of 0.8 decides.
NEAR_WORDS = 5
NEAR_BITS = 14
NEAR_SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.keep_good_texts(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id."""
    small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are near copies of one that stays."""
    small_batches(spark)
    return simhash.drop_near_copies(
        docs, NEAR_WORDS, NEAR_BITS, NEAR_SIMILARITY, every_pair=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected token shares are the tempered shares of sources, languages, topics."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and token_ids per document."""
    small_batches(spark)
    return bpe.encode_documents(docs, VOCABULARY, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near),
    ("mixing", mixed), ("bpe", encoded),
]

# The compression rules cannot be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows, written and read like the others."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
