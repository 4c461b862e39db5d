"""Trading costs and lot arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelspark.schemas import ZERO_COMMISSION, Broker

# Exchange fees and the board lot.
STAMP_PER_1000 = 1.0
STAMP_CAP = 200.0
CLEARING_RATE = 0.0003
CLEARING_CAP = 1000.0
BOARD_LOT = 100
MAX_ENTRY_COST = 0.01
DEFAULT_SPREAD_BPS = 15.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def brokerage(value: Column, rate_pct, min_fee, sst=0.08) -> Column:
    return F.greatest(value * _col(rate_pct) / 100.0, _col(min_fee)) * (1.0 + _col(sst))


def stamp_duty(value: Column) -> Column:
    """One unit per thousand or part of a thousand, capped."""
    duty = F.least(F.ceil(value / 1000.0) * STAMP_PER_1000, F.lit(STAMP_CAP))
    return F.when(value > 0, duty).otherwise(0.0)


def clearing_fee(value: Column) -> Column:
    return F.when(value > 0, F.least(value * CLEARING_RATE, F.lit(CLEARING_CAP))).otherwise(0.0)


def slippage(value: Column, half_spread_bps=DEFAULT_SPREAD_BPS, impact_bps=0.0) -> Column:
    return value * (_col(half_spread_bps) + _col(impact_bps)) / 10_000.0


def total_cost(value: Column, rate_pct, min_fee, sst=0.08, spread_bps=DEFAULT_SPREAD_BPS) -> Column:
    """One side of a trade, all components."""
    fee = F.when(value > 0, brokerage(value, rate_pct, min_fee, sst)).otherwise(0.0)
    return fee + stamp_duty(value) + clearing_fee(value) + slippage(value, spread_bps)


def trade_cost(value: Column, broker: Broker = ZERO_COMMISSION,
               spread_bps=DEFAULT_SPREAD_BPS) -> Column:
    """Struct of the cost components; a negative contract value fails the query."""
    checked = F.when(value < 0, F.raise_error(F.lit("contract value must not be negative"))
                     .cast("double")).otherwise(value)
    fee = F.when(checked > 0, brokerage(checked, broker.rate_pct, broker.min_fee, broker.sst)).otherwise(0.0)
    stamp, clearing, slip = stamp_duty(checked), clearing_fee(checked), slippage(checked, spread_bps)
    total = fee + stamp + clearing + slip
    return F.struct(
        checked.alias("value"), fee.alias("brokerage"), stamp.alias("stamp_duty"),
        clearing.alias("clearing_fee"), slip.alias("slippage"), total.alias("total"),
        F.when(checked == 0, 0.0).otherwise(total / checked * 100.0).alias("pct"))


def round_trip_pct(value: Column, rate_pct=0.0, min_fee=0.0, sst=0.08,
                   spread_bps=DEFAULT_SPREAD_BPS) -> Column:
    total = total_cost(value, rate_pct, min_fee, sst, spread_bps)
    return F.when(value == 0, 0.0).otherwise(2.0 * total / value * 100.0)


breakeven_move_pct = round_trip_pct


def affordable_lots(price: Column, budget) -> Column:
    budget = _col(budget)
    return (F.when((price > 0) & (budget > 0), F.floor(budget / (price * BOARD_LOT)))
            .otherwise(0).cast("bigint"))


def max_affordable_names(median_price: Column, capital) -> Column:
    capital = _col(capital)
    lot = median_price * BOARD_LOT
    return F.coalesce(F.when((capital > 0) & (lot > 0), F.floor(capital / lot)), F.lit(0)).cast("bigint")


def affordable_breadth(capital, min_fee, hard_cap: int = 200) -> Column:
    """Names an account can enter without fees exceeding one percent of it."""
    per_name = F.greatest(_col(min_fee), F.lit(0.01))
    names = (_col(capital) * MAX_ENTRY_COST / per_name).cast("int")
    return F.greatest(F.lit(1), F.least(names, F.lit(hard_cap)))


def broker_breadth(capital: float, broker: Broker, hard_cap: int = 200) -> int:
    """The same figure for a known account, as a number for building a plan."""
    return max(1, min(int(capital * MAX_ENTRY_COST / max(broker.min_fee, 0.01)), hard_cap))
