"""Point-in-time universe: membership in force, trailing liquidity, price band, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.prices import add_median, by_ticker
from panelspark.operators.quality import is_true
from panelspark.schemas import ScreenConfig

MIN_NAMES = 40
SCREEN_FLAGS = ["member", "liquid", "priced", "seasoned", "eligible"]


def release_spans(lists: DataFrame, backfill: bool = False) -> DataFrame:
    """Each release with the dates it is in force, until the next one."""
    dates = lists.agg(F.array_sort(F.collect_set("list_date")).alias("r"))  # one entry per release
    spans = dates.select(F.posexplode("r").alias("i", "release"), "r").select(
        "release",
        (F.when(F.col("i") == 0, F.lit("0001-01-01").cast("date")).otherwise(F.col("release")) if backfill
         else F.col("release")).alias("starts"),
        F.try_element_at("r", F.col("i") + 2).alias("ends"))
    return spans


def members_on(lists: DataFrame, date: str, backfill: bool = False) -> DataFrame:
    """Members of the latest release on or before a date; none before the first unless backfilled."""
    day = F.lit(date).cast("date")
    spans = release_spans(lists, backfill).filter((F.col("starts") <= day) & (F.col("ends").isNull() | (F.col("ends") > day)))
    return lists.join(spans.select(F.col("release").alias("list_date")), "list_date", "left_semi").select("ticker").distinct()


def add_membership(panel: DataFrame, lists: DataFrame, backfill: bool = False) -> DataFrame:
    """As-of membership: is the ticker on the latest list at its date?

    The release dates (one entry per release) are a scalar each row looks its
    release up in; a ticker's own releases come by a join on ticker, which keeps
    the partitioning the per-ticker windows need.  The panel is never shuffled
    by date, where one date may hold much of it.
    """
    releases = lists.agg(F.array_sort(F.collect_set("list_date"))).scalar()
    mine = lists.groupBy("ticker").agg(F.collect_set("list_date").alias("_mine"))
    out = panel.join(mine, "ticker", "left").withColumn("_all", releases)
    latest = F.array_max(F.filter("_all", lambda r: r <= F.col("date")))
    if backfill:
        latest = F.coalesce(latest, F.array_min("_all"))
    return out.select(*[F.col(c) for c in panel.columns], is_true(F.array_contains("_mine", latest)).alias("member"))


def add_liquidity(panel: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Traded value, its median over the bars before this one, and bars so far."""
    prior = by_ticker().rowsBetween(-cfg.lookback_bars, -1)
    out = panel.withColumn("dtv", F.col("close") * F.col("volume"))
    out = add_median(out, F.collect_list("dtv").over(prior), "median_dtv", cfg.lookback_bars // 2)
    return out.withColumn("bars_available", F.row_number().over(by_ticker()) - 1)


def screen(panel: DataFrame, cfg: ScreenConfig = ScreenConfig(), lists: DataFrame | None = None) -> DataFrame:
    """The panel with one flag per condition and their conjunction ``eligible``."""
    if cfg.require_membership and lists is None:
        raise ValueError("membership is required but no lists were given")
    out = add_liquidity(panel, cfg)
    out = add_membership(out, lists, cfg.backfill) if cfg.require_membership else out.withColumn("member", F.lit(True))
    out = out.select(
        "*", is_true(F.col("median_dtv") >= cfg.min_median_dtv).alias("liquid"),
        is_true(F.col("close").between(cfg.min_price, cfg.max_price)).alias("priced"),
        (F.col("bars_available") >= cfg.min_history).alias("seasoned"))
    return out.withColumn("eligible", F.col("member") & F.col("liquid") & F.col("priced") & F.col("seasoned"))


def universe_on(screened: DataFrame, date: str) -> DataFrame:
    return (screened.filter((F.col("date") == F.lit(date).cast("date")) & F.col("eligible"))
            .select("ticker").distinct().orderBy("ticker"))


def rejection_reasons(screened: DataFrame, date: str | None = None) -> DataFrame:
    """Every ticker's flags on one date, or on all dates when none is given."""
    rows = screened if date is None else screened.filter(F.col("date") == F.lit(date).cast("date"))
    return rows.select("date", "ticker", "close", "median_dtv", "bars_available", *SCREEN_FLAGS)


def screen_summary(screened: DataFrame) -> DataFrame:
    return screened.groupBy("date").agg(
        F.countDistinct("ticker").alias("n_listed"),
        *[F.sum(F.col(c).cast("int")).alias(f"n_{c}") for c in SCREEN_FLAGS])


def universe_series(screened: DataFrame) -> DataFrame:
    return screen_summary(screened).select("date", "n_listed", "n_eligible")


def eligibility_report(screened: DataFrame) -> DataFrame:
    """Flags unpivoted to (date, ticker, condition, passed, detail)."""
    detail = {"member": F.lit(None).cast("double"), "liquid": F.col("median_dtv"), "priced": F.col("close"),
              "seasoned": F.col("bars_available").cast("double")}
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("passed"), d.alias("detail"))
                     for c, d in detail.items()])
    return screened.select("date", "ticker", F.explode(rows).alias("c")).select("date", "ticker", "c.*")


def names_per_date(screened: DataFrame) -> DataFrame:
    return screened.filter("eligible").groupBy("date").agg(F.countDistinct("ticker").alias("n_eligible"))


def latest_tradable(screened: DataFrame, min_names: int = MIN_NAMES) -> DataFrame:
    """The newest date with a real universe; one row, null when there is none."""
    return names_per_date(screened).filter(F.col("n_eligible") >= min_names).agg(F.max("date").alias("as_of"))


def freshness(screened: DataFrame, today: str, max_age_days: int, min_names: int = MIN_NAMES) -> DataFrame:
    """Age of the newest usable date, and whether newer partial dates exist."""
    newest = screened.agg(F.max("date").alias("newest")).scalar()
    age = F.date_diff(F.lit(today).cast("date"), "as_of")
    return latest_tradable(screened, min_names).withColumn("newest", newest).select(
        "as_of", "newest", age.alias("age_days"), is_true(age <= max_age_days).alias("fresh"),
        (F.col("newest") > F.col("as_of")).alias("ragged_edge"))


def backfilled_share(screened: DataFrame, lists: DataFrame) -> DataFrame:
    """Eligible bars that rest on a list actually in force, and those that do not."""
    real = F.col("date") >= lists.agg(F.min("list_date")).scalar()
    return screened.filter("eligible").withColumn("_real", real.cast("bigint")).agg(
        F.count("*").alias("n_eligible"), F.sum("_real").alias("n_point_in_time"),
        F.sum(1 - F.col("_real")).alias("n_backfilled"), F.countDistinct("ticker").alias("n_names"))
