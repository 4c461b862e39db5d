"""Decoding landed chart payloads (JSON text) into bars and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.schemas import BAR_COLUMNS

PAYLOAD = (
    "STRUCT<timestamp: ARRAY<BIGINT>, "
    "indicators: STRUCT<quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, "
    "close: ARRAY<DOUBLE>, volume: ARRAY<DOUBLE>>>, adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>, "
    "events: STRUCT<splits: MAP<STRING, STRUCT<numerator: DOUBLE, denominator: DOUBLE>>, "
    "dividends: MAP<STRING, STRUCT<amount: DOUBLE>>>>")


def _decoded(payloads: DataFrame) -> DataFrame:
    """Rows of (ticker, payload[, error]); failed fetches carry an error and are left out."""
    if "error" in payloads.columns:
        payloads = payloads.filter(F.col("error").isNull())
    return payloads.select("ticker", F.from_json("payload", PAYLOAD).alias("p"))


def _epoch_date(seconds, utc_offset_hours: int):
    return F.date_from_unix_date(F.floor((seconds + utc_offset_hours * 3600) / 86400).cast("int"))


def payload_bars(payloads: DataFrame, utc_offset_hours: int = 0) -> DataFrame:
    """Parallel arrays to bar rows: no close, no bar; null volume is zero."""
    q = F.col("p.indicators.quote")[0]
    adj = F.try_element_at(F.col("p.indicators.adjclose"), F.lit(1))["adjclose"]
    zipped = F.arrays_zip(
        F.col("p.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"),
        q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"),
        F.coalesce(adj, q["close"]).alias("adj_close"))
    rows = _decoded(payloads).select("ticker", F.explode(zipped).alias("b")).select("ticker", "b.*")
    return (rows.filter(F.col("close").isNotNull())
            .withColumn("date", _epoch_date(F.col("t"), utc_offset_hours))
            .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
            .select(*BAR_COLUMNS))


def payload_events(payloads: DataFrame, kind: str = "splits", utc_offset_hours: int = 0) -> DataFrame:
    """Corporate actions; a split's value is numerator/denominator, a dividend's its amount."""
    if kind not in ("splits", "dividends"):
        raise ValueError(f"unknown event kind {kind!r}")
    rows = _decoded(payloads).select("ticker", F.explode(F.col(f"p.events.{kind}")).alias("at", "e"))
    value = (F.try_divide(F.coalesce(F.col("e.numerator"), F.lit(0.0)), F.coalesce(F.col("e.denominator"), F.lit(1.0)))
             if kind == "splits" else F.col("e.amount"))
    return rows.select(_epoch_date(F.col("at").cast("bigint"), utc_offset_hours).alias("date"),
                       "ticker", value.alias("value"))


def landed_panel(payloads: DataFrame, utc_offset_hours: int = 0) -> DataFrame:
    """Bars of all successful fetches; fails when there are none."""
    bars = payload_bars(payloads, utc_offset_hours)
    if bars.isEmpty():
        raise ValueError("no payload holds any bars")
    return bars


def to_payloads(bars: DataFrame, events: DataFrame) -> DataFrame:
    """The inverse, one payload per ticker and year: how a landing job would store them.

    An array holds at most one entry per trading day of the year.
    """
    yearly = ["ticker", "year"]
    cols = ["open", "high", "low", "close", "volume", "adj_close"]
    t = (F.unix_date("date").cast("bigint") * 86400).alias("t")
    packed = (bars.withColumn("year", F.year("date")).groupBy(*yearly)
              .agg(F.array_sort(F.collect_list(F.struct(t, *cols))).alias("b")))
    splits = (events.withColumn("year", F.year("date")).groupBy(*yearly)
              .agg(F.map_from_entries(F.collect_list(F.struct(
                  (F.unix_date("date").cast("bigint") * 86400).cast("string").alias("k"),
                  F.struct(F.col("value").alias("numerator"), F.lit(1.0).alias("denominator")).alias("v"))))
                  .alias("splits")))
    body = F.struct(
        F.col("b.t").alias("timestamp"),
        F.struct(F.array(F.struct(*[F.col(f"b.{c}").alias(c) for c in cols[:5]])).alias("quote"),
                 F.array(F.struct(F.col("b.adj_close").alias("adjclose"))).alias("adjclose")).alias("indicators"),
        F.struct("splits").alias("events"))
    return packed.join(splits, yearly, "left").select(
        "ticker", "year", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
