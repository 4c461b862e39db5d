"""Factors, base rates, backtests, metrics, walk-forward and concentration on generated panels."""

import math

import numpy as np
import pandas as pd
import pytest
from panels import bars, days, ramp
from pyspark.sql import Window as W, functions as F

from panelspark.operators import backtest, baselines, baserates, calendar, concentration, factors, metrics, walkforward
from panelspark.operators.literals import rows
from panelspark.schemas import BANK_STD, BacktestConfig


def study(spark, series, **kw):
    return factors.study_panel(bars(spark, series, **kw))


def walk(seed, n, drift=0.0):
    rng = np.random.default_rng(seed)
    return (5 * np.exp(np.cumsum(rng.normal(drift, 0.02, n)))).tolist()


def holey(spark, series, drop):
    df = bars(spark, series)
    return factors.study_panel(df.join(spark.createDataFrame(drop, "ticker STRING, date DATE"), ["ticker", "date"], "left_anti"))


def test_factors_match_the_pivoted_definition(spark):
    n = 220
    series = {t: walk(i, n) for i, t in enumerate("ABCD")}
    drop = [("B", days(n)[k]) for k in (40, 41, 100, 180, 199)] + [("C", d) for d in days(n)[:90]]
    got = factors.with_factors(holey(spark, series, drop)).toPandas().set_index(["date", "ticker"])
    long = got.reset_index()
    px = long.pivot(index="date", columns="ticker", values="adj_close")
    last = px.index[-1]
    mom = px.iloc[-22] / px.iloc[-147] - 1
    rev = -(px.iloc[-1] / px.iloc[-22] - 1)
    vol = px.ffill().pct_change(fill_method=None).iloc[-63:].std() * math.sqrt(252)
    dtv = (long.assign(v=long.close * long.volume)).pivot(index="date", columns="ticker", values="v")
    surge = dtv.iloc[-5:].mean() / dtv.iloc[-63:].mean()
    for t in "ABCD":
        row = got.loc[(last, t)]
        for name, want in (("momentum", mom), ("reversal", rev), ("volatility", vol), ("volume_surge", surge)):
            if pd.isna(want[t]):
                assert pd.isna(row[name]), (t, name)
            else:
                assert row[name] == pytest.approx(want[t], rel=1e-9), (t, name)
        assert row.low_vol == pytest.approx(-row.volatility)
    first = got.loc[(px.index[145], "A")]
    assert pd.isna(first.momentum) and not pd.isna(first.volatility)


def test_prior_vol_restarts_inside_its_window(spark):
    n, lb = 90, 20
    series = {t: walk(i + 9, n) for i, t in enumerate("AB")}
    drop = [("B", days(n)[k]) for k in (55, 60, 61, 70)]
    panel = holey(spark, series, drop)
    got = panel.select("date_idx", "ticker", concentration.prior_vol(lb).alias("v"), concentration.prior_momentum(lb).alias("m")).toPandas()
    px = panel.toPandas().pivot(index="date_idx", columns="ticker", values="adj_close").reindex(range(n))
    for s in (75, 80, 85):
        hist = px.iloc[s - lb:s]
        want = hist.ffill().pct_change(fill_method=None).std()
        for t in "AB":
            row = got[(got.date_idx == s) & (got.ticker == t)].iloc[0]
            assert row.v == pytest.approx(want[t], rel=1e-9)
            m = hist[t].iloc[-1] / hist[t].iloc[0] - 1
            assert (pd.isna(m) and pd.isna(row.m)) or row.m == pytest.approx(m)


def test_strategy_arguments():
    for bad in ((), (("nonsense", 1.0),), (("momentum", -1.0),)):
        with pytest.raises(ValueError):
            factors.Strategy("x", bad)


def test_score_needs_every_live_factor_and_components_do_not(spark):
    rows_ = [(0, "d", t, raw, other) for t, raw, other in (("A", 1.0, 1.0), ("B", 2.0, None), ("C", 3.0, 3.0))]
    wide = spark.createDataFrame(rows_, "first_idx INT, date STRING, ticker STRING, momentum DOUBLE, reversal DOUBLE")
    wide = wide.withColumn("low_vol", F.lit(None).cast("double"))
    s = factors.Strategy("s", (("momentum", 2.0), ("reversal", 1.0), ("low_vol", 1.0)), 2)
    ranked = factors.percentile_ranks(wide, ["momentum", "reversal", "low_vol"])
    scores = {r.ticker: r.score for r in factors.composite_scores(ranked, [s]).collect()}
    assert scores == {"A": pytest.approx(100 / 3 / 2 + 50 / 4), "C": pytest.approx(75.0)}
    parts = {r.ticker: r.score for r in factors.composite_components(ranked, s).collect()}
    assert parts["B"] == pytest.approx(200 / 3 / 2)
    assert [r.ticker for r in factors.top_n(factors.composite_scores(ranked, [s]), [s]).orderBy("place").collect()] == ["C", "A"]


def test_forward_return_enters_on_the_next_bar(spark):
    df = bars(spark, {"A": [10.0, 20, 21, 22, 23]}, adj=1.0)
    assert baserates.forward_returns(df, 2).orderBy("date").first().fwd_return == pytest.approx(0.1)


def test_buckets_match_qcut_and_span_dates(spark):
    series = {f"T{i:02d}": walk(i, 120) for i in range(23)}
    ready = baserates.forward_returns(baserates.add_factor(bars(spark, series), "momentum", 20), 5)
    got = baserates.bucket_cross_sectionally(ready).toPandas()
    day = got[got.date == got.date.iloc[0]].sort_values("factor")
    want = pd.qcut(day.factor.rank(method="first"), 10, labels=False) + 1
    assert (day.bucket == want).all() and got.groupby("bucket").date.nunique().nunique() == 1
    stats = {r.bucket: r for r in baserates.summarise_buckets(baserates.bucket_cross_sectionally(ready), 5).collect()}
    mine = got[got.bucket == 10].fwd_return
    assert stats[10].p05 == pytest.approx(np.percentile(mine, 5)) and stats[10].mean == pytest.approx(mine.mean())
    assert stats[10].independent_periods == pytest.approx(got.date.nunique() / 5)
    few = baserates.bucket_cross_sectionally(ready.filter("ticker < 'T06'"))
    assert few.count() == 0


def test_planted_drift_is_found(spark):
    series = {f"T{i:02d}": walk(i, 260, 0.0025 if i < 20 else -0.0015) for i in range(40)}
    rates = {r.bucket: r["median"] for r in baserates.base_rates(bars(spark, series)).collect()}
    assert rates[10] > rates[1] + 0.03


def test_current_bucket_and_reasons(spark):
    panel = bars(spark, {f"T{i:02d}": walk(i, 80) for i in range(20)}).withColumn("eligible", F.col("ticker") != "T00")
    as_of = panel.agg(F.max("date").alias("as_of"))
    b = baserates.current_buckets(panel, as_of)
    best = b.orderBy("rank").first()
    assert best.rank == 1 and best.bucket == 10 and best.n_universe == 19
    assert baserates.locate(b, best.ticker, as_of).first().found
    assert baserates.locate(b, "T00", as_of).first().reason == "not eligible on this date"


def run(spark, panel, signals, cfg, rule="ME"):
    cal = calendar.calendar(panel)
    decisions = calendar.schedules(cal, calendar.whole_history(cal, [rule]))
    runs = rows(spark, backtest.RUN_SCHEMA, [backtest.run_row("r", rule, cfg)])
    return backtest.run_backtests(panel, cal, runs, decisions, signals(decisions), cfg.max_positions), decisions


def hold(tickers):
    def signals(decisions):
        names = F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker")
        return decisions.select(F.lit("r").alias("run_id"), "decision_date", names).select(
            "*", F.lit(1.0).alias("weight"), F.col("ticker").alias("signal_rank"))
    return signals


def test_fills_on_the_next_bar_and_earns_after_it(spark):
    closes = [10.0] * 60
    closes[1:] = [20.0] * 59     # jump on the fill date of the first decision
    closes[2:] = [30.0] * 58     # jump the day after it
    panel = study(spark, {"A": closes, "B": ramp(60)})
    res, decisions = run(spark, panel, hold(["A"]), BacktestConfig(slippage_bps=0.0))
    assert decisions.orderBy("step").first().decision_date == days(60)[0]
    assert days(60)[59] not in [r.decision_date for r in decisions.collect()]
    got = [r.ret for r in res.returns.orderBy("date").collect()]
    assert got[0] == 0 and got[1] < 0 and got[1] > -0.01 and got[2] == pytest.approx(0.5)


def test_rebalance_calendars(spark):
    panel = bars(spark, {"A": ramp(300)})
    got = [r.decision_date for r in calendar.rebalance_dates(panel, "ME").orderBy("step").collect()]
    s = pd.Series(days(300), index=pd.DatetimeIndex(days(300)))
    want = sorted({days(300)[0], *s.resample("ME").last().dropna()} - {days(300)[299]})
    assert got == want
    week = [r.decision_date for r in calendar.rebalance_dates(panel, "W-FRI").orderBy("step").collect()]
    assert week == sorted({days(300)[0], *s.resample("W-FRI").last().dropna()} - {days(300)[299]})


def test_ineligible_names_are_not_held(spark):
    panel = study(spark, {"A": ramp(60), "B": ramp(60)}).withColumn("eligible", F.col("ticker") == "B")
    res, _ = run(spark, panel, hold(["A", "B"]), BacktestConfig())
    assert {(r.ticker, r.weight) for r in res.targets.collect()} == {("B", 1.0)}


def test_recurrence_matches_a_plain_loop(spark):
    names = [f"T{i}" for i in range(12)]
    panel = study(spark, {t: walk(i, 300) for i, t in enumerate(names)})

    def signals(decisions):
        picks = decisions.select("decision_date", "step", F.explode(F.array(*[F.lit(t) for t in names])).alias("ticker"))
        keep = F.pmod(F.col("step") + F.ascii(F.substring("ticker", 2, 1)), F.lit(3)) == 0
        return picks.filter(keep).select(F.lit("r").alias("run_id"), "decision_date", "ticker",
                                         (1.0 + F.length("ticker")).alias("weight"), F.col("ticker").alias("signal_rank"))

    cfg = BacktestConfig(capital=700.0, broker=BANK_STD, max_positions=4)
    res, decisions = run(spark, panel, signals, cfg)
    held, equity, want = {}, cfg.capital, []
    targets = {}
    for r in res.targets.collect():
        targets.setdefault(r.step, {})[r.ticker] = r.weight
    for d in decisions.orderBy("step").collect():
        now = targets.get(d.step, {})
        assert len(now) <= 4 and (not now or sum(now.values()) == pytest.approx(1))
        cost = 0.0
        for t in sorted(set(held) | set(now)):
            delta = abs(now.get(t, 0) - held.get(t, 0))
            if delta > 1e-9:
                v = delta * equity
                cost += max(v * 0.001, 30) * 1.08 + min(math.ceil(v / 1000), 200) + min(v * 0.0003, 1000) + v * 0.0015
        want.append((d.step, equity, min(cost, equity), cost >= equity))
        if cost >= equity:
            break
        equity, held = equity - cost, now
    got = [(r.step, r.equity_before, r.charged, r.ruined) for r in res.steps.orderBy("step").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and got[-1][3] and want[-1][3]
    np.testing.assert_allclose([g[1:3] for g in got], [w[1:3] for w in want])
    eq = res.returns.orderBy("date").toPandas()
    assert eq.equity.min() == 0 and (eq.ret > -1).all() and res.summary.first().cost_drag <= 1.0 + 1e-9
    assert res.summary.first().ruined_on is not None


def test_random_trials_are_reproducible_and_matched(spark):
    panel = study(spark, {f"T{i:02d}": walk(i, 120) for i in range(15)})
    a = baselines.random_backtests(panel, BacktestConfig(), 3, 6, 1)
    b = baselines.random_backtests(panel.repartition(7), BacktestConfig(), 3, 6, 1)
    key = lambda r: sorted((x.run_id, x.step, x.ticker) for x in r.targets.collect())
    assert key(a) == key(b)
    assert {r["count"] for r in a.targets.groupBy("run_id", "step").count().collect()} == {3}
    c = baselines.random_backtests(panel, BacktestConfig(), 3, 6, 2)
    assert key(a) != key(c)


def series(spark, values, name="r"):
    return spark.createDataFrame([(name, d, None if v is None else float(v)) for d, v in zip(days(len(values)), values)], "run_id STRING, date DATE, ret DOUBLE")


def test_metrics_by_hand(spark):
    r = np.array([0.01, -0.02, 0.03, -0.01, 0.02])
    got = metrics.summarise(series(spark, [None, *r])).first()
    eq = np.cumprod(1 + r)
    assert got.n_periods == 5 and got.total_return == pytest.approx(eq[-1] - 1)
    assert got.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252)) and got.hit_rate == 0.6
    assert got.sortino == pytest.approx(r.mean() / r[r < 0].std(ddof=1) * math.sqrt(252))
    assert got.max_dd == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())
    first_loss = metrics.summarise(series(spark, [-0.5, 0.1])).first()
    assert first_loss.max_dd == 0
    flat = metrics.summarise(series(spark, [0.0] * 10), n_trials=5).first()
    assert flat.sharpe == 0 and flat.vol == 0 and flat.skew == 0 and flat.kurt == 3


def test_deflation_falls_with_trials(spark):
    rng = np.random.default_rng(0)
    s = metrics.summarise(series(spark, rng.normal(0.001, 0.01, 500)))
    dsr = [metrics.deflate(s, n).first().dsr for n in (1, 10, 100, 1000)]
    assert dsr == sorted(dsr, reverse=True) and dsr[0] > 0.9 > dsr[-1]


def test_walk_forward_windows_do_not_leak(spark):
    panel = study(spark, {f"T{i}": walk(i, 1500, 0.0003 * i) for i in range(8)}, start="2019-01-01")
    cal = calendar.calendar(panel)
    folds = [r.asDict() for r in walkforward.make_splits(cal).orderBy("fold").collect()]
    assert len(folds) >= 3
    last = days(1500, "2019-01-01")[-1]
    for f in folds:
        assert f["train_start"] < f["train_end"] == f["test_start"] < f["test_end"] < f["holdout_start"] < last
    for a, b in zip(folds, folds[1:]):
        assert a["test_end"] == b["test_start"]
    with pytest.raises(ValueError):
        walkforward.make_splits(cal.limit(90))


def test_live_pick(spark):
    panel = study(spark, {"UP": ramp(100, 1, 5), "FLAT": [2.0] * 100, "DEAR": [900.0] * 100}).withColumn("median_dtv", F.lit(1.0))
    as_of = panel.agg(F.max("date").alias("as_of"))
    got = concentration.pick(concentration.enrich(concentration.rank_universe(panel, as_of), 1000.0), 1).orderBy("place").collect()
    assert [(r.ticker, r.role) for r in got] == [("UP", "pick"), ("FLAT", "runner-up")] and got[0].lots == 2


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_partition_count_does_not_change_results(spark, partitions):
    panel = study(spark, {f"T{i:02d}": walk(i, 160) for i in range(25)}).repartition(5)
    names = ["momentum", "realised_vol"]
    names = [n for n in factors.FACTORS if n in names] or list(factors.FACTORS)[:2]

    def ranks():
        return factors.percentile_ranks(factors.factor_values(panel, names), names).orderBy("date", "ticker").toPandas()

    want, old = ranks(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = ranks()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(got, want)


def test_custom_signal(spark):
    panel = study(spark, {"A": ramp(60), "B": ramp(60)})

    def best(p, decisions):
        return decisions.select("decision_date", F.lit("A").alias("ticker"), F.lit(2.0).alias("weight"), F.lit("1").alias("signal_rank"))

    res = backtest.run_signal(panel, best)
    assert {(r.ticker, r.weight) for r in res.targets.collect()} == {("A", 1.0)}
    with pytest.raises(ValueError, match="3 dates"):
        backtest.run_signal(study(spark, {"A": [1.0, 2.0]}), best)


@pytest.mark.parametrize("name", ["screened", "top_n_signal", "base_rates", "split_detect", "leaderboard"])
def test_plans_have_no_cross_join_and_prune_columns(spark, name):
    from panels import SF
    from panelspark.plans.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "l_tax" not in plan and "l_returnflag" not in plan


def test_lookahead_guard_catches_a_signal_that_sees_the_future(spark):
    panel = study(spark, {t: walk(i, 400) for i, t in enumerate("ABCDEF")}).withColumn("eligible", F.lit(True))
    order = W.partitionBy("decision_date").orderBy(F.col("x").desc(), "ticker")

    def best(column):
        def signal(known, decisions):
            scored = known.withColumn("x", column).select(F.col("date").alias("decision_date"), "ticker", "x").filter("x is not null")
            picked = scored.join(decisions.select("decision_date"), "decision_date", "left_semi").withColumn("n", F.row_number().over(order)).filter("n <= 2")
            return picked.select("decision_date", "ticker", F.lit(1.0).alias("weight"), F.format_string("%06d", "n").alias("signal_rank"))
        return signal

    by = W.partitionBy("ticker").orderBy("date")
    cuts = ["2020-09-30", "2021-02-26"]
    honest = backtest.lookahead_report(panel, best(F.col("close") / F.lag("close", 20).over(by)), cuts).collect()
    cheat = backtest.lookahead_report(panel, best(F.lead("close", 5).over(by) / F.col("close")), cuts).collect()
    mean = backtest.lookahead_report(panel, best(F.col("close") / F.avg("close").over(W.partitionBy("ticker"))), cuts).collect()
    assert all(r.clean and r.n_decisions > 4 for r in honest)
    assert not any(r.clean for r in cheat) and not any(r.clean for r in mean)


def test_a_stored_study_is_joined_where_it_lies(spark):
    """With broadcasts off, nothing is exchanged above the scan of the study."""
    from panels import SF
    from panelspark.sources.tables import stored_study

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = stored_study(spark, SF)
        targets = spark.createDataFrame([("r", 0, "S000001", 1.0)], "run_id STRING, step INT, ticker STRING, weight DOUBLE")
        steps = spark.createDataFrame([("r", 0, 5, 9, 20)], "run_id STRING, step INT, exec_idx INT, next_exec_idx INT, last_idx INT")
        plan = backtest.gross_returns(targets, steps, panel)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
        depth = lines[scan].index("FileScan")
        above = []
        for x in reversed(lines[:scan]):
            at = len(x) - len(x.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(x.strip(" :+-"))
                depth = at
        join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
        assert not any(x.startswith("Exchange") for x in above[:join]), above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
