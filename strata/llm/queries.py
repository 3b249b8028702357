"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    byte_bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    html_extract,
    language_id,
    license_scan,
    mixing,
    secret_scan,
    simhash,
    source_divergence,
    token_counts,
    toxicity,
)
from strata.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.secret_scan(read_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(read_table(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_main_text(read_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.token_digests(byte_bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, decode=True))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_repair(read_table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_secret_scan,
        op2_toxicity,
        op3_embedding_near_dedup,
        op4_exact_dedup,
        op5_simhash_near_dedup,
        op6_language_id,
        op7_html_main_text,
        op8_license_scan,
        op9_byte_bpe,
        op10_mixing,
        op11_conversation_repair,
        op12_source_divergence,
        op13_token_counts,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_license_scan": license_scan.oracle_sql(),
        "op10_mixing": mixing.oracle_sql(),
        "op11_conversation_repair": conversation_repair.oracle_sql(),
        "op12_source_divergence": source_divergence.ORACLE_SQL,
    }
