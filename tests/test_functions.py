import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import costs, draws, sessions, stats, symbols
from panelspark.operators import positions
from panelspark.schemas import BANK_LOW, BANK_STD, ZERO_COMMISSION


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("value,stamp,clearing", [
    (0.0, 0, 0), (1.0, 1, 0.0003), (1000.0, 1, 0.3), (1001.0, 2, 0.3003), (200_000.0, 200, 60), (500_000.0, 200, 150),
    (10_000_000.0, 200, 1000)])
def test_fees(spark, value, stamp, clearing):
    got = one(spark, s=costs.stamp_duty(F.lit(value)), c=costs.clearing_fee(F.lit(value)))
    assert got.s == stamp and got.c == pytest.approx(clearing)


@pytest.mark.parametrize("broker,want", [(ZERO_COMMISSION, (0.46, 0.26, 0.26)), (BANK_LOW, (3.92, 1.99, 0.48)), (BANK_STD, (13.42, 6.74, 0.91))])
def test_round_trip_without_spread(spark, broker, want):
    for value, pct in zip((500.0, 1000.0, 10_000.0), want):
        got = one(spark, p=costs.round_trip_pct(F.lit(value), broker.rate_pct, broker.min_fee, broker.sst, 0.0)).p
        assert round(got, 2) == pct


def test_negative_value_fails(spark):
    with pytest.raises(Exception, match="must not be negative"):
        one(spark, c=costs.trade_cost(F.col("id") - 5.0))


def test_trade_cost_adds_up(spark):
    c = one(spark, c=costs.trade_cost(F.lit(1000.0), BANK_LOW)).c
    assert c.total == pytest.approx(c.brokerage + c.stamp_duty + c.clearing_fee + c.slippage)
    assert one(spark, c=costs.trade_cost(F.lit(0.0), BANK_STD)).c.total == 0


def test_lots_and_breadth(spark):
    got = one(spark, a=costs.affordable_lots(F.lit(12.0), 10_000.0), b=costs.affordable_lots(F.lit(0.0), 10.0),
              c=costs.max_affordable_names(F.lit(2.0), 1000.0), d=costs.affordable_breadth(10_000.0, 8.0),
              e=costs.affordable_breadth(10_000.0, 0.0), f=costs.affordable_breadth(10.0, 30.0))
    assert tuple(got) == (8, 0, 5, 12, 200, 1)
    assert costs.broker_breadth(10_000.0, BANK_LOW) == 12


def test_symbols(spark):
    got = one(spark, a=symbols.to_symbol(F.lit(" 0001 ")), b=symbols.to_symbol(F.lit("0001.kl")), c=symbols.bare_code(F.lit("MY.03065")),
              d=symbols.bare_code(F.lit("03065.KL")), e=symbols.to_prefixed(F.lit("0270.KL")), f=symbols.pad_code(F.lit(" 12")),
              g=symbols.pad_code(F.lit("03065")))
    assert tuple(got) == ("0001.KL", "0001.KL", "03065", "03065", "MY.0270", "0012", "03065")


@pytest.mark.parametrize("clock,status,start", [
    ("08:59", "closed", None), ("09:00", "open", 9), ("12:29", "open", 9), ("12:30", "lunch break", None), ("14:29", "lunch break", None),
    ("14:30", "open", 14), ("16:59", "open", 14), ("17:00", "closed", None), ("23:00", "closed", None)])
def test_sessions(spark, clock, status, start):
    ts = F.lit(f"2024-05-06 {clock}:00").cast("timestamp_ntz")
    got = one(spark, s=sessions.market_status(ts), b=sessions.session_start(ts))
    assert got.s == status and (got.b.hour if got.b else None) == start


def test_weekend_and_staleness(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    got = one(spark, a=sessions.market_status(at("2024-05-04 10:00:00")),
              lunch=sessions.staleness(at("2024-05-06 12:30:00"), at("2024-05-06 13:30:00")),
              reopen=sessions.staleness(at("2024-05-06 12:30:00"), at("2024-05-06 14:31:00")),
              halted=sessions.staleness(at("2024-05-06 12:30:00"), at("2024-05-06 15:31:00")),
              none=sessions.staleness(F.lit(None).cast("timestamp_ntz"), at("2024-05-06 15:31:00")))
    assert tuple(got) == ("weekend", "lunch break", "delayed", "stale", "no timestamp")


def test_normal_helpers(spark):
    assert positions.expected_winning_score(400) == pytest.approx(0.1492, abs=1e-4)
    assert stats.expected_max_normal(1) == 0
    df = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z DOUBLE").select(stats.normal_cdf(F.col("z")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[0] == 0.5 and got[1] == pytest.approx(0.975, abs=1e-4) and (got[2] is None or math.isnan(got[2]))


def test_sample_positions_are_distinct_and_uniform(spark):
    df = spark.range(4000).select(draws.sample_positions(F.lit(8), 3, F.lit(1), F.col("id")).alias("p"))
    assert df.filter(F.size(F.array_distinct("p")) != 3).count() == 0
    counts = {r.x: r["count"] for r in df.select(F.explode("p").alias("x")).groupBy("x").count().collect()}
    assert set(counts) == set(range(1, 9)) and all(abs(c - 1500) < 160 for c in counts.values())
    whole = spark.range(1).select(draws.sample_positions(F.lit(3), 9, F.col("id")).alias("p")).first().p
    assert sorted(whole) == [1, 2, 3]


def test_rules_in_order(spark):
    base = dict(days_left=10, my_return=0.1, target_return=0.29, halted=False, still_eligible=True, momentum_at_entry=0.5, momentum_now=0.5)
    cases = [({"halted": True, "still_eligible": False}, "SWITCH", "halted"), ({"still_eligible": False, "days_left": 1}, "SWITCH", "not_eligible"),
             ({"days_left": 3, "momentum_now": 0.0}, "HOLD", "endgame"), ({"momentum_now": 0.1}, "SWITCH", "momentum_spent"),
             ({}, "HOLD", "behind"), ({"my_return": 0.4}, "HOLD", "ahead"), ({"momentum_at_entry": 0.0, "momentum_now": -1.0}, "HOLD", "behind")]
    rows = [tuple({**base, **c}.values()) for c, _, _ in cases]
    df = spark.createDataFrame(rows, "days_left INT, my_return DOUBLE, target_return DOUBLE, halted BOOLEAN, still_eligible BOOLEAN, "
                                     "momentum_at_entry DOUBLE, momentum_now DOUBLE")
    assert [(r.action, r.reason) for r in positions.decide(df).collect()] == [(a, w) for _, a, w in cases]


def test_assess(spark):
    df = spark.createDataFrame([(0.5, 10), (0.1, 0), (0.145, 10), (0.1, 10), (-0.9, 10)], "my_return DOUBLE, days_left INT")
    assert [r.verdict for r in positions.assess(df).collect()] == ["ahead", "over", "on-track", "behind", "far-behind"]


def test_missing_quote_is_worth_nothing(spark):
    held = spark.createDataFrame([("A", 100, 2.0), ("B", 100, 2.0)], "ticker STRING, shares BIGINT, entry_price DOUBLE")
    quoted = spark.createDataFrame([("A", 2.5, 2.0, None)], "ticker STRING, price DOUBLE, prev_close DOUBLE, error STRING")
    got = {r.ticker: r for r in positions.standing(held, quoted, F.lit(1000.0)).collect()}
    assert got["A"].equity == 1050 and got["A"].pnl_pct == pytest.approx(0.25)
    assert got["B"].equity == 800 and got["B"].position_value is None


def test_quote_age(spark):
    q = spark.createDataFrame([("A", dt.datetime(2024, 5, 6, 10, 0))], "ticker STRING, quoted_at TIMESTAMP_NTZ")
    got = positions.quote_status(q, F.lit("2024-05-06 10:20:00").cast("timestamp_ntz")).first()
    assert got.age_minutes == 20 and got.staleness == "delayed"
