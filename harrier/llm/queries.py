"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, cross_polytope, decontaminate, divergence, language_id, log_bilinear, minhash_dedup, quality_fm, secret_scan, sharding, suffix_dedup, token_files
from .common import held_out, table

#: The tokenizers' vocabulary files; a parameter of the operators.
BYTE_RANKS, BYTE_PATTERN, WORD_BPE = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN, "word_bpe_49k.json"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_fm.train(docs, labels.where(~held_out(3, 1)))
    return quality_fm.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.train(docs.where(~held_out(4, 2)))
    return language_id.predict(docs, models).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_RANKS), BYTE_PATTERN)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.digest(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_suffix_dedup, op3_quality_fm, op4_language_id, op5_byte_bpe, op6_decontaminate, op7_token_files, op8_cross_polytope, op9_log_bilinear, op10_sharding, op11_divergence, op12_conversation_trie, op13_secret_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontaminate.oracle_sql(), "op11_divergence": divergence.oracle_sql(), "op12_conversation_trie": conversation_trie.oracle_sql(), "op13_secret_scan": secret_scan.oracle_sql()}
