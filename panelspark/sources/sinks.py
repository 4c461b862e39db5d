"""Writing panels, snapshots, logs and code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOURNAL = ("decision STRING, decided_at TIMESTAMP, rule STRING, ticker STRING, price DOUBLE, lots BIGINT, notional DOUBLE, capital DOUBLE, "
           "score DOUBLE")


def write_panel(panel: DataFrame, path: str, by_year: bool = False) -> None:
    writer = panel.withColumn("year", F.year("date")) if by_year else panel
    out = writer.write.mode("overwrite")
    (out.partitionBy("year") if by_year else out).parquet(path)


def replace_snapshot(lists: DataFrame, path: str) -> None:
    """Write membership releases; re-running a release replaces that release only."""
    (lists.dropDuplicates(["list_date", "ticker"]).repartitionByRange("list_date", "ticker")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("list_date").parquet(path))


def record_decision(picks: DataFrame, path: str, decision: str, rule: str, capital: float, decided_at: Column | None = None) -> None:
    """Journal of decisions, one folder each: later decisions are added, and writing one again replaces that one only.

    ``decision`` names the decision (its date, or a run's id), so a job that is tried twice doesn't log it twice.
    """
    (picks.select(F.lit(decision).alias("decision"), (F.current_timestamp() if decided_at is None else decided_at).alias("decided_at"),
                  F.lit(rule).alias("rule"), "ticker", "price", "lots", "notional", F.lit(float(capital)).alias("capital"), "score")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("decision").parquet(path))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).parquet(path)


def write_verified(summary: DataFrame, path: str) -> None:
    """Codes that returned data, one sorted CSV."""
    (summary.filter("ok").select(F.col("ticker").alias("code")).distinct().orderBy("code")
     .write.mode("overwrite").option("header", True).csv(path))
