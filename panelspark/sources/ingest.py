"""Reading, normalising and merging bars, events, membership and code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.symbols import pad_code, to_symbol
from panelspark.schemas import BARS, BAR_COLUMNS, EVENTS, require_columns

# Vendor column spellings.
VENDOR_NAMES = {"Date": "date", "Datetime": "date", "Open": "open", "High": "high", "Low": "low",
                "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


def load_panel(spark: SparkSession, path: str | list[str], tickers: list[str] | DataFrame | None = None) -> DataFrame:
    """Parquet bars; a ticker list becomes a pushed-down filter, a table a semi join."""
    bars = spark.read.schema(BARS).parquet(*([path] if isinstance(path, str) else path)).select(*BAR_COLUMNS)
    if isinstance(tickers, DataFrame):
        return bars.join(tickers.select("ticker"), "ticker", "left_semi")
    return bars if tickers is None else bars.filter(F.col("ticker").isin(list(tickers)))


def _latest_row(keys: list[str], df: DataFrame, order: Column, largest: bool) -> DataFrame:
    """One row per key by an order; partial aggregation collapses copies before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def normalise(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """Vendor frame to BARS: names, types, mirrored adj_close, first row per date.

    ``arrival`` names the column giving input order; without it the whole row
    orders the copies, so the result does not depend on partitioning.
    """
    df = raw.withColumnsRenamed({k: v for k, v in VENDOR_NAMES.items() if k in raw.columns})
    require_columns(df, ["date", "ticker", "close"], "bars")
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    numeric = [c for c in BAR_COLUMNS if c not in ("date", "ticker")]
    order = F.col(arrival) if arrival else None
    df = df.select(
        F.col("date").cast("date").alias("date"), to_symbol(F.col("ticker")).alias("ticker"),
        *[F.col(c).try_cast("double").alias(c) for c in numeric],
        *([order.alias("_arrival")] if arrival else []))
    df = df.filter(F.col("close").isNotNull())
    order = F.col("_arrival") if arrival else F.struct(*numeric)
    return _latest_row(["ticker", "date"], df, order, largest=False).select(*BAR_COLUMNS)


def upsert_fresh_wins(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge two bar tables on (ticker, date); the fresh row replaces the cached one."""
    both = (cached.select(*BAR_COLUMNS).withColumn("_p", F.lit(0))
            .unionByName(fresh.select(*BAR_COLUMNS).withColumn("_p", F.lit(1))))
    values = [c for c in BAR_COLUMNS if c not in ("ticker", "date")]
    return _latest_row(["ticker", "date"], both, F.struct("_p", *values), largest=True).select(*BAR_COLUMNS)


def upsert_by_year(cached: DataFrame, fresh: DataFrame, parts: int) -> DataFrame:
    """The same, with ``year``: rows are dealt by ticker into ``parts`` and sorted once, by year first, as a table by year is written."""
    values = [c for c in BAR_COLUMNS if c not in ("ticker", "date")]
    both = (cached.select(*BAR_COLUMNS).withColumn("_p", F.lit(0))
            .unionByName(fresh.select(*BAR_COLUMNS).withColumn("_p", F.lit(1)))).repartition(parts, "ticker")
    return (both.groupBy(F.year("date").alias("year"), "ticker", "date").agg(F.max(F.struct("_p", *values)).alias("_r"))
            .select("year", "ticker", "date", "_r.*").select(*BAR_COLUMNS, "year"))


def load_raw(spark: SparkSession, pattern: str) -> DataFrame:
    """Landed vendor files under a glob, whatever columns each has: schemas are merged, and spellings of one column made one.

    A column that a file lacks is null in its rows; of two spellings in one row the first that holds a value counts.
    """
    found = spark.read.option("mergeSchema", True).parquet(pattern)
    spellings: dict[str, list[str]] = {}
    for c in found.columns:
        spellings.setdefault(VENDOR_NAMES.get(c, c), []).append(c)
    return found.select(*[F.coalesce(*[F.col(f"`{c}`") for c in held]).alias(name) for name, held in spellings.items()])


def read_csv(spark: SparkSession, path: str, schema: str, bad: str = "bad_record") -> DataFrame:
    """CSV files by a declared schema, so that codes keep their zeros; a line that doesn't fit it is kept whole in ``bad``.

    The header of every file has to name the declared columns.
    """
    return (spark.read.schema(f"{schema}, {bad} STRING").option("header", True).option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", bad).csv(path))


def load_membership(spark: SparkSession, path: str, skip_undated: bool = False) -> DataFrame:
    """Membership snapshots from CSV; codes stay strings.  A date that doesn't read is an error, or its line is left out."""
    found = spark.read.option("header", True).csv(path)  # other columns may stand beside these two, in any order
    require_columns(found, ["list_date", "ticker"], path)
    if skip_undated:
        found = found.withColumn("list_date", F.col("list_date").try_cast("date")).filter(F.col("list_date").isNotNull())
    return clean_membership(found)


def clean_membership(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("list_date").cast("date").alias("list_date"),
                        to_symbol(F.col("ticker")).alias("ticker")).dropDuplicates()


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Recorded actions from CSV, with lines that don't fit in ``bad_record``."""
    return read_csv(spark, path, EVENTS)


def events_profile(events: DataFrame) -> DataFrame:
    """What a record of actions holds: lines, lines that don't read, tickers, usable values, and its span."""
    good = F.col("bad_record").isNull()
    return events.agg(F.count("*").alias("n_lines"), F.count_if(~good).alias("n_bad"), F.count_distinct("ticker").alias("n_tickers"),
                      F.count_if(good & (F.col("value") > 0)).alias("n_usable"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def merge_events(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Union of event records; values are rounded first so one event has one spelling."""
    both = recorded.select("date", "ticker", "value").unionByName(found.select("date", "ticker", "value"))
    return (both.withColumn("value", F.round("value", 8)).filter(F.col("value").isNotNull())
            .dropDuplicates(["ticker", "date", "value"]))


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("header", True).csv(path)
    require_columns(found, ["code"], path)
    return candidate_codes(found)


def candidate_codes(codes: DataFrame) -> DataFrame:
    return codes.select(pad_code(F.col("code").cast("string")).alias("code")).distinct().orderBy("code")


def fetch_worklist(listed: DataFrame, cached: DataFrame, limit: int | None = None) -> DataFrame:
    """Listed tickers with no cached bars yet."""
    todo = listed.select("ticker").join(cached.select("ticker").distinct(), "ticker", "left_anti")
    return todo.orderBy("ticker").limit(limit) if limit else todo


def load_summary(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows and span per requested ticker; absence is reported, not raised."""
    found = bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"),
                                       F.max("date").alias("last_date"))
    rows = F.coalesce(F.col("rows"), F.lit(0))
    return (requested.select("ticker").distinct().join(found, "ticker", "left")
            .select("ticker", rows.alias("rows"), "first_date", "last_date", (rows > 0).alias("ok")))


def coverage_profile(bars: DataFrame, days: int = 90, floor: float = 500_000.0) -> DataFrame:
    """Per ticker: bars, and median traded value over the last ``days`` before the newest date."""
    since = bars.agg(F.date_sub(F.max("date"), days)).scalar()
    traded = F.when(F.col("_recent"), F.col("close") * F.col("volume"))
    return (bars.withColumn("_recent", F.col("date") > since)
            .groupBy("ticker")
            .agg(F.count("*").alias("n_bars"), F.percentile(traded, F.lit(0.5)).alias("median_recent_dtv"))
            .withColumn("above_floor", F.coalesce(F.col("median_recent_dtv") >= floor, F.lit(False))))


def coverage_summary(profile: DataFrame) -> DataFrame:
    """One row over a coverage profile: tickers, spread of their bars, and how many trade above the floor."""
    return profile.agg(F.count("*").alias("n_tickers"), F.min("n_bars").alias("min_bars"), F.median("n_bars").alias("median_bars"),
                       F.max("n_bars").alias("max_bars"), F.count_if("above_floor").alias("n_above_floor"))
