"""Table schemas and study settings.

A panel is one row per (ticker, date).  Codes and tickers are strings: leading
zeros are significant, so no reader here ever infers a schema.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

BARS = ("date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, "
        "close DOUBLE, adj_close DOUBLE, volume DOUBLE")
EVENTS = "date DATE, ticker STRING, value DOUBLE"
MEMBERSHIP = "list_date DATE, ticker STRING"
CODES = "code STRING"
RETURNS = "run_id STRING, date DATE, ret DOUBLE"

BAR_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume"]
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]

PERIODS_PER_YEAR = 252


@dataclass(frozen=True)
class ScreenConfig:
    """Thresholds of the point-in-time universe screen."""

    min_median_dtv: float = 500_000.0
    lookback_bars: int = 60
    min_price: float = 0.20
    max_price: float = 50.0
    min_history: int = 120
    require_membership: bool = True
    backfill: bool = False


@dataclass(frozen=True)
class Broker:
    """A fee schedule: percentage rate, minimum per trade, service tax on brokerage."""

    name: str
    rate_pct: float
    min_fee: float
    sst: float = 0.08


# The three fee schedules.
ZERO_COMMISSION = Broker("zero_commission", 0.0, 0.0)
BANK_LOW = Broker("bank_low", 0.1, 8.0)
BANK_STD = Broker("bank_std", 0.1, 30.0)
BROKERS = (ZERO_COMMISSION, BANK_LOW, BANK_STD)


@dataclass(frozen=True)
class BacktestConfig:
    """How a ranking is traded.  rebalance is one of ME, W-FRI, YE."""

    capital: float = 10_000.0
    rebalance: str = "ME"
    broker: Broker = ZERO_COMMISSION
    slippage_bps: float = 15.0
    max_positions: int = 5


@dataclass(frozen=True)
class WindowConfig:
    """Concentrated portfolios over windows: dates held and dates of history, names that have to be on offer, seed of draws."""

    horizon: int = 21
    lookback: int = 60
    min_names: int = 15
    seed: int = 0


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")
    return df
