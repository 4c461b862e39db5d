"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage works on all that the one before it kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from panelspark.llm.queries import table, tokenizer_path
from panelspark.llm.ship import ship
from panelspark.scratch import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one has."""
    ship(spark)
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    ship(spark)
    return packing.packed_pieces(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates),
          ("decontamination", benchmark), ("packing", pack)]

#: The covariance determinants are found by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
