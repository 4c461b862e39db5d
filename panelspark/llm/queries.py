"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import (byte_bpe, conversation_repair, decontaminate, interpolation_lm, line_dedup, merkle, ngram_join, packing, personal_data, quality_rules,
                            secret_scan, suffix_dedup, url_templates)
from panelspark.llm.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file by which texts are packed: ``PACKING_TOKENIZER``, else the public package's."""
    if path := os.environ.get("PACKING_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_interpolation_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.scores(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.url_digest(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"), passages=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_spans(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.class_digest(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_digest(table(spark, sf_dir, "conversations"))


def bpe_files() -> tuple[str, str]:
    """The rank file and the pattern of pre-tokens: ``BPE_RANKS`` and the public package's."""
    import public_tokenizers

    return os.environ.get("BPE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"), *bpe_files())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_interpolation_lm, op2_secret_scan, op3_quality_rules, op4_url_templates, op5_decontamination, op6_suffix_dedup,
                            op7_packing, op8_personal_data, op9_line_dedup, op10_ngram_join, op11_merkle, op12_conversation_repair,
                            op13_byte_bpe)}
