"""Trading sessions and quote age.  Inputs are market-local times (UTC+8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Session bounds in minutes after midnight, stale limit, zone.
MORNING = (9 * 60, 12 * 60 + 30)
AFTERNOON = (14 * 60 + 30, 17 * 60)
STALE_MINUTES = 45
MARKET_ZONE = "+08:00"


def to_market_time(instant: Column) -> Column:
    """A UTC instant as market-local time; naive values already are local."""
    return F.from_utc_timestamp(instant, MARKET_ZONE)


def _minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def _within(minute: Column, bounds: tuple[int, int]) -> Column:
    return (minute >= bounds[0]) & (minute < bounds[1])


def market_status(ts: Column) -> Column:
    m = _minute(ts)
    return (F.when(F.weekday(ts) >= 5, "weekend")
            .when(_within(m, MORNING) | _within(m, AFTERNOON), "open")
            .when(_within(m, (MORNING[1], AFTERNOON[0])), "lunch break")
            .otherwise("closed"))


def session_start(ts: Column) -> Column:
    """Start of the session in progress, or null."""
    m = _minute(ts)
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    trading_day = F.weekday(ts) < 5
    return (F.when(trading_day & _within(m, MORNING), day + F.expr(f"INTERVAL {MORNING[0]} MINUTES"))
            .when(trading_day & _within(m, AFTERNOON), day + F.expr(f"INTERVAL {AFTERNOON[0]} MINUTES")))


def minutes_between(later: Column, earlier: Column) -> Column:
    later, earlier = later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", earlier, later) / 60_000_000.0


def session_age_minutes(quoted_at: Column, now: Column) -> Column:
    """Age counted only from the start of the running session."""
    return minutes_between(now, F.greatest(quoted_at.cast("timestamp_ntz"), session_start(now)))


def staleness(quoted_at: Column, now: Column) -> Column:
    status = market_status(now)
    return (F.when(quoted_at.isNull(), "no timestamp")
            .when(status != "open", status)
            .when(session_age_minutes(quoted_at, now) > STALE_MINUTES, "stale")
            .otherwise("delayed"))
