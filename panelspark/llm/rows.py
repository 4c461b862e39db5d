"""How the operators tell rows apart, and how they read a session's settings.

A row is known by its id and the hash of its text.  Rows that repeat both give the
same result, so results are joined back by the pair and nothing is multiplied; rows
that share an id but not a text keep results of their own.  A null id is an id like
any other, ordered before all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
ID, HASH = "__row_id", "__row_hash"


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_ID))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the id, the pair that names a row, and the text (null as null)."""
    return docs.select(F.col("doc_id"), F.col(text), row_id().alias(ID),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(HASH))


def keyed_whole(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and the pair that names a row."""
    return docs.withColumns({ID: row_id(), HASH: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
