"""Interval and as-of joins against brute force, with keys that hold most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import ordering, repair, timejoin
from panels import bars

START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def test_within_days_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice("ABC"), day(rng.randrange(300)), i) for i in range(200)] + [(None, day(3), 900), ("A", None, 901)]
    right = [(rng.choice("AAAAAB"), day(rng.randrange(300)), i) for i in range(400)] + [(None, day(3), 900), ("A", None, 901)]
    a = spark.createDataFrame(left, "ticker STRING, date DATE, l INT")
    b = spark.createDataFrame(right, "ticker STRING, at DATE, r INT")
    for days in (0, 1, 7, 45):
        got = sorted((r.l, r.r) for r in timejoin.within_days(a, b, "ticker", "date", "at", days).collect())
        want = sorted((x[2], y[2]) for x in left for y in right
                      if x[0] and x[0] == y[0] and x[1] and y[1] and abs((x[1] - y[1]).days) <= days)
        assert got == want, days
    got = sorted((r.l, r.r) for r in timejoin.within_days(a, b, "ticker", "date", "at", 9, 2).collect())
    assert got == sorted((x[2], y[2]) for x in left for y in right
                         if x[0] and x[0] == y[0] and x[1] and y[1] and -9 <= (x[1] - y[1]).days <= 2)


def test_a_ticker_of_many_events_is_joined_by_bins(spark):
    """100,000 actions of one ticker: no array of them, and work only where dates are near."""
    panel = bars(spark, {"HOT": [10.0] * 40 + [5.0] * 40, "B": [3.0] * 80})
    events = spark.range(100_000).select(F.date_add(F.lit(START), (F.col("id") % 20_000).cast("int") - 10_000).alias("date"), F.lit("HOT").alias("ticker"),
                                         F.when(F.col("id") == 10_056, 2.0).otherwise(1.0 + F.col("id") / 1e7).alias("value"))
    found = repair.detect_splits(panel, events).filter("is_split")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_bin" in plan
    assert [(r.ticker, r.recorded_ratio) for r in found.collect()] == [("HOT", 2.0)]
    located = repair.locate_recorded_splits(panel, events).filter("needs_repair and ratio = 2.0").collect()
    assert len(located) == 1 and located[0].date == found.first().date


@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_brute_force(spark, strict):
    rng = random.Random(4)
    left = [(rng.choice("HHHHHHAB"), rng.randrange(200), i) for i in range(600)] + [("H", 50, 1000 + i) for i in range(300)] + [(None, 5, 2000), ("A", None, 2001)]
    right = [(rng.choice("HHHHAC"), rng.randrange(20, 180), rng.random()) for _ in range(150)] + [("H", 60, 0.5), ("H", 60, 0.7), (None, 1, 1.0), ("A", None, 2.0)]
    a = spark.createDataFrame(left, "k STRING, t INT, id INT").repartition(5)
    b = spark.createDataFrame(right, "k STRING, at INT, v DOUBLE").repartition(3)
    got = {r.id: r.v for r in timejoin.asof(a, b, "k", "t", "at", ["v"], strict).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        known = [(at, v) for kk, at, v in right if k is not None and t is not None and kk == k and at is not None and (at < t if strict else at <= t)]
        assert got[i] == (max(known)[1] if known else None), (k, t)


def test_asof_splits_a_hot_key(spark):
    left = spark.range(20_000).select(F.lit("H").alias("k"), (F.col("id") % 1000).alias("t"), "id")
    right = spark.range(100).select(F.lit("H").alias("k"), (F.col("id") * 10).alias("at"), F.col("id").alias("v"))
    out = timejoin.asof(left, right, "k", "t", "at", ["v"])
    assert out.filter("v <> floor(t / 10)").count() == 0 and out.count() == 20_000


def test_ranks_with_one_hot_value(spark):
    """Half of all rows share a value: they lie in several slices, and their rank is that of the whole run."""
    rows = [("d", i, 5.0 if i % 2 else float(i), None if i % 10 == 0 else float(i % 3)) for i in range(4000)] + [("e", i, None, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g STRING, i INT, v DOUBLE, w DOUBLE").repartition(6)
    for names in (["v"], ["v", "w"]):
        got = {(r.g, r.i): r for r in ordering.average_rank_pcts(df, ["g"], names).collect()}
        assert len(got) == len(rows)
        for n in names:
            for g in "de":
                held = sorted(r["v" if n == "v" else "w"] for r in got.values() if r.g == g and r[n] is not None)
                first, count = {}, {}
                for place, x in enumerate(held, 1):
                    first.setdefault(x, place)
                    count[x] = count.get(x, 0) + 1
                for r in got.values():
                    if r.g == g:
                        assert r[f"n_{n}"] == len(held)
                        want = None if r[n] is None else (first[r[n]] + (count[r[n]] - 1) / 2) / len(held) * 100
                        assert r[f"pct_{n}"] == want or abs(r[f"pct_{n}"] - want) < 1e-9
