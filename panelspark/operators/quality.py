"""Data-quality checks.  Each returns its violations; validate() summarises all ten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.prices import by_ticker, row_return
from panelspark.schemas import PRICE_COLUMNS

# Check thresholds and the moves a missed split would leave.
EXTREME_MOVE = 0.35
SPLIT_SIGNATURES = (-0.500, -0.667, -0.750, -0.800, 1.000, 2.000)
SPLIT_TOL = 0.02
MAX_GAP_DAYS = 10
MAX_ZERO_SHARE = 0.20
MIN_BARS = 120


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bad_brackets() -> Column:
    high, low = F.col("high"), F.col("low")
    return is_true(high < low) | is_true(high < F.greatest("open", "close")) | is_true(low > F.least("open", "close"))


def not_positive() -> Column:
    return reduce(lambda a, b: a | b, [is_true(F.col(c) <= 0) for c in PRICE_COLUMNS])


def has_missing() -> Column:
    return reduce(lambda a, b: a | b,
                  [F.col(c).isNull() for c in ("date", "ticker", "close", "adj_close", "volume")])


def ohlc_brackets(panel: DataFrame) -> DataFrame:
    return panel.filter(bad_brackets())


def positive_prices(panel: DataFrame) -> DataFrame:
    return panel.filter(not_positive())


def missing_values(panel: DataFrame) -> DataFrame:
    return panel.filter(has_missing())


def duplicate_keys(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker", "date").agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicates(panel: DataFrame) -> DataFrame:
    """Every row of a (ticker, date) held more than once.

    Keys are counted by partial aggregation and joined back, so a key with very
    many copies is split by the adaptive join, not windowed in one task.
    """
    return panel.join(duplicate_keys(panel), ["ticker", "date"])


def monotonic_dates(panel: DataFrame, seq: str = "seq") -> DataFrame:
    """Tickers whose dates step back in arrival order, which ``seq`` records."""
    arrival = W.partitionBy("ticker").orderBy(seq)
    back = panel.select("ticker", is_true(F.lag("date").over(arrival) > F.col("date")).alias("_b"))
    return back.groupBy("ticker").agg(F.sum(F.col("_b").cast("int")).alias("steps_back")).filter("steps_back > 0")


def adjustment_applied(panel: DataFrame) -> DataFrame:
    """Tickers whose adjusted close never leaves the raw one."""
    close = is_true(F.abs(F.col("close") - F.col("adj_close")) <= 1e-8 + 1e-9 * F.abs("adj_close"))
    return (panel.groupBy("ticker").agg(F.bool_and(close).alias("_same"), F.count("*").alias("n_bars"))
            .filter("_same").drop("_same"))


def _arrival(panel: DataFrame, seq: str | None) -> list[str]:
    """Date, and the arrival order of copies of a date where the panel records it."""
    return ["date"] + [seq] * (seq is not None and seq in panel.columns)


def extreme_moves(panel: DataFrame, seq: str | None = "seq") -> DataFrame:
    before = F.lag("adj_close").over(W.partitionBy("ticker").orderBy(*_arrival(panel, seq)))
    moves = panel.withColumn("adj_ret", F.try_divide(F.col("adj_close"), before) - 1.0).filter(F.abs("adj_ret") > EXTREME_MOVE)
    near = F.exists(F.array(*[F.lit(s) for s in SPLIT_SIGNATURES]), lambda s: F.abs(F.col("adj_ret") - s) < SPLIT_TOL)
    return moves.withColumn("near_split_ratio", near)


def calendar_gaps(panel: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    gap = F.date_diff("date", F.lag("date").over(by_ticker()))
    return panel.withColumn("gap_days", gap).filter(F.col("gap_days") > max_gap_days)


def zero_volume(panel: DataFrame, max_share: float = MAX_ZERO_SHARE) -> DataFrame:
    idle = (F.coalesce("volume", F.lit(0.0)) <= 0).cast("int")
    return (panel.groupBy("ticker").agg(F.avg(idle).alias("zero_volume_share"))
            .filter(F.col("zero_volume_share") > max_share))


def history_depth(panel: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    return panel.groupBy("ticker").agg(F.count("*").alias("n_bars")).filter(F.col("n_bars") < min_bars)


# The names of the checks.
ALL_CHECKS = {
    "OHLC brackets": ohlc_brackets,
    "positive prices": positive_prices,
    "no duplicates": duplicates,
    "no missing values": missing_values,
    "monotonic dates": monotonic_dates,
    "adjustment applied": adjustment_applied,
    "extreme moves": extreme_moves,
    "calendar gaps": calendar_gaps,
    "zero-volume bars": zero_volume,
    "history depth": history_depth,
}


_SUMMED = ["brackets", "positive", "missing", "back", "extreme", "gap", "idle"]


def _per_key(panel: DataFrame, seq: str | None, max_gap_days: int) -> DataFrame:
    """What each (ticker, date) adds to the checks: row flags and lags in one pass over the ticker partitioning."""
    ordered = W.partitionBy("ticker").orderBy(*_arrival(panel, seq))
    back = (is_true(F.lag("date").over(W.partitionBy("ticker").orderBy(seq)) > F.col("date"))
            if seq else F.lit(False))
    prev_adj = F.lag("adj_close").over(ordered)
    move = F.try_divide(F.col("adj_close"), prev_adj) - 1.0
    flags = panel.select(
        "ticker", "date",
        bad_brackets().alias("brackets"), not_positive().alias("positive"), has_missing().alias("missing"),
        back.alias("back"), is_true(F.abs(move) > EXTREME_MOVE).alias("extreme"),
        is_true(F.date_diff("date", F.lag("date").over(ordered)) > max_gap_days).alias("gap"),
        is_true(F.abs(F.col("close") - F.col("adj_close")) <= 1e-8 + 1e-9 * F.abs("adj_close")).alias("same"),
        (F.coalesce("volume", F.lit(0.0)) <= 0).alias("idle"))

    def count(c: str) -> Column:
        return F.sum(F.col(c).cast("bigint"))

    return flags.groupBy("ticker", "date").agg(
        F.count("*").alias("n"), F.bool_and("same").alias("same"), *[count(c).alias(c) for c in _SUMMED])


def validate(panel: DataFrame, seq: str | None = "seq", max_gap_days: int = MAX_GAP_DAYS,
             max_zero_share: float = MAX_ZERO_SHARE, min_bars: int = MIN_BARS) -> DataFrame:
    """One row per check: check, passed, n_bad.  Never fails on bad data.

    The order of arrival is checked where the panel has the column ``seq``; else that check's row is null, for it did
    not run.

    All ten share one exchange on ticker: row flags and lags are computed in one
    pass, rolled up per (ticker, date), per ticker, and then to a single row.
    """
    seq = seq if seq in panel.columns else None
    per_key = _per_key(panel, seq, max_gap_days)
    per_ticker = per_key.groupBy("ticker").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("copies"),
        F.bool_and("same").alias("same"), *[F.sum(c).alias(c) for c in _SUMMED])
    real = F.col("ticker").isNotNull()
    bad = {
        "OHLC brackets": F.sum("brackets"),
        "positive prices": F.sum("positive"),
        "no duplicates": F.sum("copies"),
        "no missing values": F.sum("missing"),
        "monotonic dates": F.sum((real & (F.col("back") > 0)).cast("bigint")),
        "adjustment applied": F.sum((real & F.col("same")).cast("bigint")),
        "extreme moves": F.sum("extreme"),
        "calendar gaps": F.sum("gap"),
        "zero-volume bars": F.sum((real & (F.col("idle") / F.col("n") > max_zero_share)).cast("bigint")),
        "history depth": F.sum((real & (F.col("n") < min_bars)).cast("bigint")),
    }
    one = per_ticker.agg(F.map_from_arrays(
        F.array(*[F.lit(k) for k in bad]),
        F.array(*[F.coalesce(v, F.lit(0)).cast("bigint") for v in bad.values()])).alias("m"))
    rows = one.select(F.explode("m").alias("check", "n_bad"))
    if seq is None:
        rows = rows.withColumn("n_bad", F.when(F.col("check") != "monotonic dates", F.col("n_bad")))
    return rows.select("check", (F.col("n_bad") == 0).alias("passed"), "n_bad")


def samples(panel: DataFrame, n: int = 3, seq: str | None = "seq", max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """A few offending rows of each check that points at rows: check, ticker, date; the smallest by ticker and date.

    One scan and ``validate``'s own exchange give the faults of each (ticker, date); every task keeps its ``n`` smallest of each check
    before the rest is merged.
    """
    faults = {"OHLC brackets": F.col("brackets") > 0, "positive prices": F.col("positive") > 0, "no duplicates": F.col("n") > 1,
              "no missing values": F.col("missing") > 0, "extreme moves": F.col("extreme") > 0, "calendar gaps": F.col("gap") > 0}
    per_key = _per_key(panel, seq if seq in panel.columns else None, max_gap_days)
    found = F.filter(F.array(*[F.when(fault, F.lit(name)) for name, fault in faults.items()]), lambda v: v.isNotNull())
    rows = per_key.select("ticker", "date", F.explode(found).alias("check"))
    place = F.row_number().over(W.partitionBy("check").orderBy("ticker", "date"))
    return rows.withColumn("_p", place).filter(F.col("_p") <= n).select("check", "ticker", "date")


def panel_span(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_bars"), F.countDistinct("ticker").alias("n_tickers"),
                     F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def assert_clean(panel: DataFrame, allow: tuple[str, ...] = ("extreme moves", "calendar gaps"), **settings) -> None:
    """Raise when a check outside ``allow`` fails; ten summary rows reach the driver."""
    failed = [r for r in validate(panel, **settings).filter(~F.col("passed")).collect() if r.check not in allow]
    if failed:
        raise ValueError("panel failed " + "; ".join(f"{r.check}: {r.n_bad}" for r in failed))
