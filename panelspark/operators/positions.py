"""Quotes, positions, and the ordered rules on what to do with a holding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions import sessions
from panelspark.functions.stats import expected_max_normal, required_vol

# Score to beat, endgame length, giveback limit, volatilities.
TARGET_RETURN = 0.29
ENDGAME_DAYS = 3
GIVEBACK = 0.60
FIELD_VOL = 0.05
CURRENT_VOL = 0.20
AGGRESSIVE_VOL = 0.70


def quote_ok() -> Column:
    return F.col("error").isNull() & F.col("price").isNotNull()


def change_pct() -> Column:
    usable = quote_ok() & (F.col("prev_close") != 0)
    return F.when(usable, F.col("price") / F.col("prev_close") - 1.0)


def latest_quotes(quotes: DataFrame, order: tuple[str, ...] = ("quoted_at",)) -> DataFrame:
    """Newest quote per ticker by partial aggregation; a busy ticker collapses before the shuffle."""
    rest = [c for c in quotes.columns if c != "ticker"]
    return (quotes.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("q"))
            .select("ticker", "q.*"))


def quote_status(quotes: DataFrame, now: Column) -> DataFrame:
    """Market state, age and staleness of each quote at ``now`` (market-local)."""
    return quotes.select(
        "*", sessions.market_status(now).alias("market"), sessions.session_start(now).alias("session_start"),
        sessions.minutes_between(now, F.col("quoted_at")).alias("age_minutes"),
        sessions.staleness(F.col("quoted_at"), now).alias("staleness"))


def standing(positions: DataFrame, quotes: DataFrame, capital: Column, target: float = TARGET_RETURN) -> DataFrame:
    """Value, gain, equity and gap to the target of each position; a missing quote is worth nothing."""
    both = positions.join(quotes, "ticker", "left")
    ok = quote_ok()
    value = F.when(ok, F.col("shares") * F.col("price"))
    pnl = F.when(ok & (F.col("entry_price") != 0), F.col("price") / F.col("entry_price") - 1.0)
    equity = capital - F.col("shares") * F.col("entry_price") + F.coalesce(value, F.lit(0.0))
    ret = F.when(capital != 0, equity / capital - 1.0)
    return both.select("ticker", "shares", "entry_price", "price", change_pct().alias("change_pct"), value.alias("position_value"),
                       pnl.alias("pnl_pct"), equity.alias("equity"), ret.alias("return_pct"),
                       F.lit(target).alias("target_pct"), (F.lit(target) - ret).alias("gap_pct"))


def giveback() -> Column:
    """Share of the selecting move that has been handed back."""
    entry, now = F.col("momentum_at_entry"), F.col("momentum_now")
    return F.when(entry <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (entry - now) / entry))


def decide(situations: DataFrame) -> DataFrame:
    """Ordered rules: structural exits, endgame, spent momentum, then hold."""
    s = situations.withColumn("giveback", giveback())
    reason = (F.when(F.col("halted"), "halted")
              .when(~F.col("still_eligible"), "not_eligible")
              .when(F.col("days_left") <= ENDGAME_DAYS, "endgame")
              .when(F.col("giveback") >= GIVEBACK, "momentum_spent")
              .when(F.col("my_return") < F.col("target_return"), "behind")
              .otherwise("ahead"))
    s = s.withColumn("reason", reason)
    switch = F.col("reason").isin("halted", "not_eligible", "momentum_spent")
    return s.withColumn("action", F.when(switch, "SWITCH").otherwise("HOLD"))


def expected_winning_score(n_entrants: int, field_vol: float = FIELD_VOL) -> float:
    if n_entrants < 2 or field_vol <= 0:
        raise ValueError("a contest needs two entrants and a positive field volatility")
    return field_vol * expected_max_normal(n_entrants)


def assess(accounts: DataFrame, n_entrants: int = 400, field_vol: float = FIELD_VOL,
           current_vol: float = CURRENT_VOL, aggressive_vol: float = AGGRESSIVE_VOL) -> DataFrame:
    """Gap to the expected winning score and the volatility that could close it.

    ``accounts`` has my_return and days_left; a negative days_left fails the query.
    """
    days = F.when(F.col("days_left") < 0, F.raise_error(F.lit("days_left must not be negative")).cast("int")
                  ).otherwise(F.col("days_left"))
    target = expected_winning_score(n_entrants, field_vol)
    a = accounts.withColumn("days_left", days).withColumn("target", F.lit(target))
    a = a.withColumn("gap", F.col("target") - F.col("my_return"))
    scale = F.sqrt(F.col("days_left") / F.lit(252.0))
    a = a.select("*", required_vol(F.col("gap")).alias("required_vol"), (scale * current_vol).alias("vol_now"),
                 (scale * aggressive_vol).alias("vol_max"))
    verdict = (F.when(F.col("days_left") == 0, "over").when(F.col("gap") <= 0, "ahead")
               .when(F.col("required_vol") <= F.col("vol_now"), "on-track")
               .when(F.col("required_vol") <= F.col("vol_max"), "behind").otherwise("far-behind"))
    daily = F.when(F.col("days_left") > 0, F.col("required_vol") / F.sqrt(F.col("days_left"))).otherwise(F.lit(math.inf))
    return a.select("*", daily.alias("required_daily_vol"), verdict.alias("verdict"))
