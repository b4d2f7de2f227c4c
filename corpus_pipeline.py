"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Counted as part of the subpackage ``llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrier.llm import byte_bpe, decontaminate, language_id, minhash_dedup, suffix_dedup
from harrier.llm.common import scratch, table
from harrier.llm.queries import BYTE_PATTERN, BYTE_RANKS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that language identification rejects go, and with them null texts and texts
    without a letter. The models are learned from the table ``documents``."""
    return language_id.known(docs, language_id.train(table(spark, sf_dir, "documents")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each class of near-duplicates stays, that with the smallest id; a row is known
    by its id and text together."""
    return minhash_dedup.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every text loses the strings of 200 bytes that are found elsewhere too. All rows stay."""
    return suffix_dedup.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that copy a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token counts and digests of ids and of the decoded bytes, beside all columns but the text."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), BYTE_PATTERN)


STAGES = [("language_id", known_language), ("minhash_dedup", one_of_each), ("suffix_dedup", no_repeats), ("decontaminate", no_benchmark), ("byte_bpe", encoded)]

#: The stages learn models and sort suffixes; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
