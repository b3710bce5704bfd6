"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgersieve.llm import (
    boosted_rules, bpe_counts, decontaminate, divergence, hard_negatives, packing, passages, pieces,
    pii, pii_sql, secret_scan, simhash, warc, weak_quality,
)
from ledgersieve.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return boosted_rules.contract(
        boosted_rules.judge(documents(spark, folder), _labels(spark, folder)))


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_counts.token_counts(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(
        documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{folder}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def _negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_weak_quality": lambda spark, folder: weak_quality.classify(documents(spark, folder)),
        "op2_decontamination": _leaks,
        "op3_packed_rows": _packed,
        "op4_boosted_rules": _rules,
        "op5_personal_data": lambda spark, folder: pii.detect(documents(spark, folder)),
        "op6_simhash_components": lambda spark, folder: simhash.components(documents(spark, folder)),
        "op7_token_counts": _token_counts,
        "op8_pieces": _pieces,
        "op9_secrets": lambda spark, folder: secret_scan.scan(documents(spark, folder)),
        "op10_repeated_passages": lambda spark, folder: passages.repeats(documents(spark, folder)),
        "op11_source_divergence": lambda spark, folder: divergence.divergence(
            documents(spark, folder)),
        "op12_web_archives": _archives,
        "op13_hard_negatives": _negatives,
    }


def oracle_sql() -> dict[str, str]:
    """The others need fingerprints, learned models, merges or a parser, which SQL has not."""
    return {
        "op5_personal_data": pii_sql.sql(),
        "op11_source_divergence": divergence.sql(),
        "op12_web_archives": warc.sql(),
        "op13_hard_negatives": hard_negatives.sql(),
    }
