"""A price panel and its companions derived from order, supplier and event tables.

Prices are unit prices of shipped lines: one bar per supplier and week.
Discounts are whole hundredths, so their mean is taken from integer sums and a
bar has one value however its rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelspark.operators.calendar import calendar
from panelspark.operators.factors import study_panel
from panelspark.operators.literals import setting_rows
from panelspark.operators.universe import screen
from panelspark.scratch import materialise, partitions_for, stored_by_ticker, table_state
from panelspark.schemas import BAR_COLUMNS, PRICE_COLUMNS, ScreenConfig

# Settings of the derived study: weekly prices are thinner than daily ones.
WEEKLY_SCREEN = ScreenConfig(min_median_dtv=400.0, max_price=50.0, min_history=52)
WEEKLY_GAP_DAYS = 21
RELEASES = (("1996-06-03", 0), ("1998-01-05", 1), ("2000-01-03", 2))  # date, region left out
EVENT_BAR = 180
SPLIT_BALANCE = 8000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(suppkey: Column) -> Column:
    return F.format_string("S%06d", suppkey)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]


def line_ticks(lines: DataFrame) -> DataFrame:
    """Order lines as trades; ``seq`` orders the trades of a supplier."""
    return lines.select(
        "l_suppkey", F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"), F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount_pct"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))


def ticks_to_bars(ticks: DataFrame, key: str = "ticker", name=lambda k: k, width: str = "7 days",
                  offset: str | None = "4 days", extra: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Tumbling OHLCV bars, the same code for a table and a stream.

    All aggregates merge.  Grouping is on the raw key; ``name`` spells the ticker
    once per bar.  The default week starts on Monday.

    Buffers that hold a struct are merged in sorted order, so combining before
    the exchange sorts every split of the table.  ``parts`` deals the plain
    trades by bar instead and sorts them once: right for a table with few trades
    a bar, where combining saves no rows.  A bar with very many trades is then
    sorted by one task, which spills and holds one buffer.
    """
    extra = extra or {}
    week = F.window("ts", width, width, offset) if offset else F.window("ts", width)
    start = F.col("w.start")
    if parts and ticks.isStreaming:  # the pair carries the watermark
        ticks = ticks.withColumn("w", week).repartition(parts, key, "w")
        week = F.col("w")
    elif parts:  # a week is known by its start: a number is dealt and sorted faster than a pair
        ticks = ticks.withColumn("w", week).withColumn("w", start).repartition(parts, key, "w")
        week = start = F.col("w")
    bars = ticks.groupBy(key, week.alias("w")).agg(
        *[c.alias(n) for n, c in extra.items()],
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("discount_pct").alias("_d"), F.count("*").alias("_n"),
        F.sum("quantity").alias("volume"))
    adjusted = F.col("close") * (1 - F.col("_d") / F.col("_n") / 100)
    return bars.withColumns({"ticker": name(F.col(key)), "date": start.cast("date"), "adj_close": adjusted}).select(
        *BAR_COLUMNS, *extra)


def line_bars(ticks: DataFrame, extra: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    return ticks_to_bars(ticks, "l_suppkey", ticker_of, extra=extra, parts=parts)


def line_partitions(spark: SparkSession, sf_dir: str) -> int:
    return partitions_for(spark, f"{sf_dir}/lineitem.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bars(line_ticks(table(spark, sf_dir, "lineitem")), parts=line_partitions(spark, sf_dir))


def weekly_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks that have bars, from one column of the lines."""
    days = table(spark, sf_dir, "lineitem").select("l_shipdate").filter(F.col("l_shipdate").isNotNull()).distinct()
    # a row a day is truncated and gathered, not a row a line; a test of the week itself would be pushed down to the lines
    return materialise(calendar(days.select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))), "calendar")


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return (table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
            .select(ticker_of(F.col("s_suppkey")).alias("ticker"), "n_regionkey", "s_acctbal"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete snapshots: each release lists every supplier outside one region."""
    lists = setting_rows("list_date DATE, out_region INT", RELEASES)
    return (supplier_regions(spark, sf_dir).select("ticker", "n_regionkey", F.inline(lists))
            .filter(F.col("n_regionkey") != F.col("out_region")).select("list_date", "ticker"))


def corporate_events(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """A consolidation for suppliers in debt, a split for rich ones, at their 180th bar."""
    at = (bars.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy("date")))
          .filter(F.col("_n") == EVENT_BAR).select("ticker", "date"))
    value = F.when(F.col("s_acctbal") < 0, 0.2).when(F.col("s_acctbal") > SPLIT_BALANCE, 2.0)
    return (supplier_regions(spark, sf_dir).select("ticker", value.alias("value")).filter(F.col("value").isNotNull())
            .join(at, "ticker").select("date", "ticker", "value"))


def unadjusted_bars(bars: DataFrame, events: DataFrame) -> DataFrame:
    """The bars as a vendor that missed every event would report them."""
    ev = events.select("ticker", F.col("date").alias("_at"), "value")
    step = F.when(F.col("date") >= F.col("_at"), F.col("value")).otherwise(1.0)
    out = bars.join(ev, "ticker", "left").withColumn("_k", F.coalesce(step, F.lit(1.0)))
    return out.select("date", "ticker", *[(F.col(c) / F.col("_k")).alias(c) for c in PRICE_COLUMNS], "volume")


def second_source(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Another vendor: slightly off, badly off for one region, silent in thin weeks."""
    regions = supplier_regions(spark, sf_dir).select("ticker", "n_regionkey")
    k = F.when(F.col("n_regionkey") == 3, 1.2).otherwise(1.003)
    return (bars.filter(F.col("volume") >= 10).join(regions, "ticker")
            .select("date", "ticker", (F.col("close") * k).alias("close"), "adj_close"))


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes; error events carry no price."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "event_id",
        F.when(~failed, F.col("value")).alias("price"), F.col("value").alias("volume"),
        F.col("ts").alias("quoted_at"), F.when(failed, "no result").alias("error"))


def screened_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir).repartition(line_partitions(spark, sf_dir), "ticker")  # as the study is stored
    return screen(bars, WEEKLY_SCREEN, membership(spark, sf_dir))


def stored_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screened panel with calendar index and return, bucketed by ticker, built once per application
    and again when its tables have changed.

    Studies read it many times; building it inside each would repeat the scan,
    the framed median and the as-of join.
    """
    state = tuple(table_state(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "nation"))
    return stored_by_ticker(spark, ("study", sf_dir, state), lambda: study_panel(
        screened_weekly(spark, sf_dir), cal=weekly_calendar(spark, sf_dir)), line_partitions(spark, sf_dir))


def arrival_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with ``seq``, the order in which their last trades were booked."""
    bars = line_bars(line_ticks(table(spark, sf_dir, "lineitem")), {"_o": F.max("seq.l_orderkey")}, line_partitions(spark, sf_dir))
    return bars.withColumn("seq", F.struct("_o", "date")).drop("_o")


def flawed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival bars with the faults a vendor feed has: nulls, bad signs, crossed
    ranges, idle bars, copies, and one region never adjusted."""
    bars = arrival_bars(spark, sf_dir).repartition(line_partitions(spark, sf_dir), "ticker").join(supplier_regions(spark, sf_dir).select("ticker", "n_regionkey"), "ticker")
    v = F.col("volume")
    close = F.when(v == 7, None).otherwise(F.col("close"))
    faulty = bars.select(
        "date", "ticker", "open", F.when(v == 17, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(v == 13, -F.col("low")).otherwise(F.col("low")).alias("low"), close.alias("close"),
        F.when(F.col("n_regionkey") == 2, close).otherwise(F.col("adj_close")).alias("adj_close"),
        F.when((v < 12) | ((F.col("n_regionkey") == 4) & (v < 26)), 0.0).otherwise(v).alias("volume"), "seq", (v == 21).alias("_twice"))
    return faulty.select(*BAR_COLUMNS, "seq", F.explode(F.when(F.col("_twice"), F.array(F.lit(1), F.lit(2)))
                                                        .otherwise(F.array(F.lit(1)))).alias("_c")).drop("_c")


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published lists as text lines: a table of changes, the full list two entries to a line, an appendix."""
    listed = membership(spark, sf_dir).select("list_date", F.substring("ticker", 2, 12).cast("bigint").alias("n"))
    pair = F.floor((F.col("n") - 1) / 2)
    entry = F.format_string("  %d.   %s   Supplier Holdings", F.col("n"),
                            F.when(F.col("n") < 10000, F.format_string("%04d", F.col("n"))).otherwise(F.col("n").cast("string")))
    body = (listed.groupBy("list_date", pair.alias("p"))
            .agg(F.min(F.struct("n", entry.alias("e"))).alias("a"), F.max(F.struct("n", entry.alias("e"))).alias("b"))
            .select("list_date", (F.col("p") + 10).alias("line_no"),
                    F.when(F.col("a.n") == F.col("b.n"), F.col("a.e"))
                    .otherwise(F.concat(F.col("a.e"), F.lit("    "), F.col("b.e"))).alias("line")))
    fixed = setting_rows("line_no BIGINT, line STRING", [
        (1, "NEWLY ADDED SECURITIES"), (2, "  1.   9901   Delta One      2.   9902   Delta Two"),
        (5, "LIST OF SHARIAH-COMPLIANT SECURITIES - MAIN MARKET"),
        (9_000_000_000, "ADDITIONAL LIST OF FUNDS"), (9_000_000_001, "  1.   9801   Fund One")])
    frame = listed.select("list_date").distinct().select("list_date", F.inline(fixed))
    return body.unionByName(frame).withColumn("doc_id", F.date_format("list_date", "yyyy-MM-dd"))
