"""Cross-sectional factors, percentile ranks and weighted composites.

Factors are computed once for every (ticker, date) by windows on the ticker and
read only bars up to that date.  Ranks compare the names eligible on a date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.prices import at_calendar_offset, change, row_return
from panelspark.operators.calendar import calendar
from panelspark.operators.ordering import average_rank_pcts
from panelspark.schemas import PERIODS_PER_YEAR
from panelspark.scratch import materialise


@dataclass(frozen=True)
class Strategy:
    """Named factor weights and the number of names to hold."""

    name: str
    weights: tuple[tuple[str, float], ...]
    top_n: int = 3

    def __post_init__(self) -> None:
        if not self.weights:
            raise ValueError("at least one factor is required")
        unknown = sorted({f for f, _ in self.weights} - set(FACTORS))
        if unknown:
            raise ValueError(f"unknown factor(s) {unknown}; available: {sorted(FACTORS)}")
        if any(w < 0 for _, w in self.weights):
            raise ValueError("weights must not be negative; use the negated factor")


def study_panel(screened: DataFrame, price: str = "adj_close", price_scope: str = "all",
                cal: DataFrame | None = None) -> DataFrame:
    """Panel with calendar index and row return.

    ``cal`` is the panel's calendar as a stored table, small enough for Spark to
    broadcast by its size; without it the dates are gathered and stored first.

    ``price_scope`` "eligible" drops ineligible bars before prices are compared,
    "all" keeps the whole price history and lets eligibility gate choices only.
    """
    if price_scope not in ("all", "eligible"):
        raise ValueError("price_scope is 'all' or 'eligible'")
    if "eligible" not in screened.columns:
        screened = screened.withColumn("eligible", F.lit(True))
    if price_scope == "eligible":
        screened = screened.filter("eligible")
    priced = screened.filter(F.col(price).isNotNull())
    if cal is None:
        cal = materialise(calendar(priced), "calendar")
    return priced.join(cal, "date").withColumn("ret", row_return(price))


def _span(first: int, last: int = 0):
    return W.partitionBy("ticker").orderBy("date_idx").rangeBetween(first, last)


def momentum(lookback: int = 126, skip: int = 21, price: str = "adj_close") -> Column:
    """Return from ``lookback+skip-1`` to ``skip`` dates ago on the shared calendar."""
    value = change(at_calendar_offset(price, -skip), at_calendar_offset(price, -(lookback + skip - 1)))
    return F.when(F.col("date_idx") >= lookback + skip - 1, value)


def reversal(lookback: int = 21, price: str = "adj_close") -> Column:
    value = -change(F.col(price), at_calendar_offset(price, -lookback))
    return F.when(F.col("date_idx") >= lookback, value)


VOL_DATES = 63


def _moments(lookback: int) -> dict[str, Column]:
    w = _span(-(lookback - 1))
    return {"_m": F.count("ret").over(w), "_var": F.var_pop("ret").over(w), "_avg": F.avg("ret").over(w),
            "_first": F.min("date_idx").over(W.partitionBy("ticker"))}


def _vol(lookback: int, _m: Column, _var: Column, _avg: Column, _first: Column) -> Column:
    n = F.least(F.lit(lookback), F.col("date_idx") - _first)
    squares = _var * _m + F.pow(_avg, F.lit(2)) * _m * (n - _m) / n
    vol = F.sqrt(squares / (n - 1)) * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))
    return F.when((F.col("date_idx") >= lookback + 1) & (n >= 2), vol)


def realised_vol(lookback: int = VOL_DATES) -> Column:
    """Annualised deviation of the last ``lookback`` calendar returns.

    A date without a bar is a zero return once the ticker has traded.  Those
    zeros enter by merging moments (m observed returns, n-m zeros), so no dense
    date-by-ticker grid is built.
    """
    return _vol(lookback, **_moments(lookback))


def low_vol(lookback: int = VOL_DATES) -> Column:
    return -realised_vol(lookback)


def volume_surge(short: int = 5, long: int = 63) -> Column:
    traded = F.col("close") * F.col("volume")
    ratio = F.try_divide(F.avg(traded).over(_span(-(short - 1))), F.avg(traded).over(_span(-(long - 1))))
    return F.when(F.col("date_idx") >= long, ratio)


FACTORS = {"momentum": momentum, "reversal": reversal, "volatility": realised_vol,
           "low_vol": low_vol, "volume_surge": volume_surge}

# Dates of history each factor needs before it has a value.
HISTORY = {"momentum": 126 + 21, "reversal": 21 + 1, "volatility": 63 + 2, "low_vol": 63 + 2, "volume_surge": 63 + 1}

# The preset weightings.
PRESETS = (
    Strategy("tournament", (("volatility", 55.0), ("momentum", 30.0), ("volume_surge", 15.0)), 3),
    Strategy("momentum", (("momentum", 70.0), ("volume_surge", 15.0), ("low_vol", 15.0)), 5),
    Strategy("reversal", (("reversal", 70.0), ("volume_surge", 15.0), ("low_vol", 15.0)), 5),
)


def with_factors(study: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or list(FACTORS)
    # low_vol is volatility with its sign turned, and a moment is used several times: as columns, each window runs once,
    # beside the other factors' windows, which share its frame
    vol = _vol(VOL_DATES, *map(F.col, _moments(VOL_DATES)))
    known = {n: c for n, c in (("volatility", vol), ("low_vol", -vol)) if n in names}
    moments = [c.alias(n) for n, c in _moments(VOL_DATES).items()] if known else []
    held = study.select("*", *moments, *[FACTORS[n]().alias(n) for n in names if n not in known])
    return held.select(*study.columns, *[known.get(n, F.col(n)).alias(n) for n in names])


def factor_values(study: DataFrame, names: list[str], dates: DataFrame | None = None) -> DataFrame:
    """Eligible names' factors, one column each: first_idx, date, ticker, factor columns.

    ``dates`` (date, first_idx) keeps only the dates a decision is made on, before
    any ranking.  ``first_idx`` is where the history a decision may use begins; a
    factor has no value until that history is long enough for it.
    """
    wide = with_factors(study, names).filter("eligible")
    if dates is None:
        wide = wide.withColumn("first_idx", F.lit(0))
    else:
        wide = wide.join(dates.select("date", "first_idx").distinct(), "date")
    seen = F.col("date_idx") - F.col("first_idx") + 1
    return wide.select("first_idx", "date", "ticker", *[F.when(seen >= HISTORY[n], F.col(n)).alias(n) for n in names])


CROSS_SECTION = ["first_idx", "date"]


def percentile_ranks(values: DataFrame, names: list[str]) -> DataFrame:
    """Add pct_<factor> and n_<factor>, the number of names that have it that date.

    All factors rank on the date, so one exchange serves them all.
    """
    return average_rank_pcts(values, CROSS_SECTION, names)


def long_ranks(ranked: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("raw"), F.col(f"pct_{n}").alias("pct")) for n in names])
    return (ranked.select("date", "ticker", F.explode(pairs).alias("p")).select("date", "ticker", "p.*")
            .filter(F.col("raw").isNotNull()))


def _shares(strategy: Strategy) -> list[tuple[str, float]]:
    total = sum(w for _, w in strategy.weights)
    return sorted((f, w / total) for f, w in strategy.weights)


def composite_scores(ranked: DataFrame, strategies=PRESETS) -> DataFrame:
    """Weighted score of the names that have every factor anyone has that date."""
    scored = []
    for s in strategies:
        total, whole, any_live = F.lit(0.0), F.lit(True), F.lit(False)
        for f, share in _shares(s):
            live, has = F.col(f"n_{f}") > 0, F.col(f"pct_{f}").isNotNull()
            total = total + F.when(live & has, F.col(f"pct_{f}") * share).otherwise(0.0)
            whole, any_live = whole & (has | ~live), any_live | live
        scored.append(F.struct(F.lit(s.name).alias("strategy"), F.when(whole & any_live, total).alias("score")))
    return (ranked.select(*CROSS_SECTION, "ticker", F.explode(F.array(*scored)).alias("s"))
            .select("s.strategy", *CROSS_SECTION, "ticker", "s.score").filter(F.col("score").isNotNull()))


def composite_components(ranked: DataFrame, strategy: Strategy) -> DataFrame:
    """Raw, percentile and contribution columns per factor, and their sum without nulls."""
    cols, total, some = [], F.lit(0.0), F.lit(False)
    for f, share in _shares(strategy):
        contrib = F.col(f"pct_{f}") * share
        cols += [F.col(f).alias(f"raw_{f}"), F.col(f"pct_{f}"), contrib.alias(f"contrib_{f}")]
        total, some = total + F.coalesce(contrib, F.lit(0.0)), some | F.col(f).isNotNull()
    return ranked.filter(some).select(*CROSS_SECTION, "ticker", *cols, total.alias("score"))


def top_n(scores: DataFrame, strategies=PRESETS) -> DataFrame:
    """The names each strategy holds, best first; the limit runs before the shuffle too."""
    most = max(s.top_n for s in strategies)
    place = F.row_number().over(W.partitionBy("strategy", *CROSS_SECTION).orderBy(F.col("score").desc(), "ticker"))
    mine = F.lit(0)
    for s in strategies:
        mine = F.when(F.col("strategy") == s.name, s.top_n).otherwise(mine)
    return scores.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") <= mine)
