"""Latest quote per ticker from a stream, and tickers whose quotes have stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.positions import latest_quotes
from panelspark.scratch import scratch_path


def quotes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a file, or a folder of files
    failed = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "event_id",
        F.when(~failed, F.col("value")).alias("price"), F.col("ts").alias("quoted_at"),
        F.when(failed, "no result").alias("error"))


def latest_stream(quotes: DataFrame, order: tuple[str, ...] = ("quoted_at", "event_id")) -> DataFrame:
    """State is one row per ticker; the newest quote wins whatever the arrival order."""
    return latest_quotes(quotes, order)


def gone_stale(quotes: DataFrame, max_age: str, late: str) -> DataFrame:
    """A row each time a ticker's quotes stop: no good quote for ``max_age`` after the last one.

    Quotes of a ticker no further apart than ``max_age`` are one session, whatever the order in which they arrive.  The watermark closes a
    session once no quote within ``late`` can prolong it: it is emitted then, without waiting for the ticker's next quote, and
    its state is freed, so state is one row for each ticker quoted within ``max_age`` + ``late`` and not for every ticker ever seen.
    """
    good = quotes.filter(F.col("price").isNotNull()).withColumn("quoted_at", F.col("quoted_at").cast("timestamp")).withWatermark("quoted_at", late)
    return good.groupBy("ticker", F.session_window("quoted_at", max_age).alias("_w")).agg(
        F.max("quoted_at").alias("last_quoted_at"), F.max_by("price", F.struct("quoted_at", "event_id")).alias("last_price"),
        F.count("*").alias("n_quotes")).select("ticker", "last_quoted_at", F.col("_w.end").alias("stale_at"), "last_price", "n_quotes")


def run_quotes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the quotes available now and return the newest per ticker."""
    path, checkpoint = scratch_path(spark, "quotes"), scratch_path(spark, "quotes-progress")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    latest = latest_stream(quotes_stream(spark, sf_dir))
    (latest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    stored = spark.read.schema(latest.schema).parquet(path)
    return latest_quotes(stored, ("quoted_at", "event_id"))


def run_stale_stream(spark: SparkSession, sf_dir: str, max_age: str, late: str) -> DataFrame:
    """Drain the quotes available now and return every time a ticker went stale."""
    path, checkpoint = scratch_path(spark, "stale"), scratch_path(spark, "stale-progress")
    stale = gone_stale(quotes_stream(spark, sf_dir), max_age, late)
    (stale.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stale.schema).parquet(path)
