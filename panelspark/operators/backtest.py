"""Backtests of many runs in one job.

A run is a row: capital, fee schedule, position limit and schedule.  Decisions
on date d fill on the next panel date; weights earn from the date after that;
sizing equity falls only by costs, and a run whose costs reach its equity is
ruined and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.costs import total_cost
from panelspark.operators.calendar import calendar, schedules, whole_history
from panelspark.operators.literals import rows
from panelspark.schemas import BacktestConfig, require_columns
from panelspark.scratch import materialise

RUN_SCHEMA = ("run_id STRING, schedule_id STRING, capital DOUBLE, rate_pct DOUBLE, min_fee DOUBLE, sst DOUBLE, "
              "spread_bps DOUBLE, max_positions INT")
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
MIN_TRADE = 1e-9

# A signal takes (study panel, decision dates per schedule) and returns
# schedule_id or run_id, decision_date, ticker, weight, signal_rank.
Signal = Callable[[DataFrame, DataFrame], DataFrame]


class BacktestResult(NamedTuple):
    returns: DataFrame      # run_id, date, date_idx, ret, equity
    targets: DataFrame      # run_id, step, ticker, weight
    turnover: DataFrame     # run_id, step, turnover
    steps: DataFrame        # run_id, step, equity_before, cost, charged, ruined, dates
    trades: DataFrame       # run_id, step, exec_date, ticker, from_w, to_w, notional, cost
    summary: DataFrame      # run_id, n_rebalances, cost_drag, avg_turnover, ruined_on


def run_row(run_id: str, schedule_id: str, cfg: BacktestConfig) -> tuple:
    b = cfg.broker
    return (run_id, schedule_id, cfg.capital, b.rate_pct, b.min_fee, b.sst, cfg.slippage_bps, cfg.max_positions)


def eligible_on(study: DataFrame, decisions: DataFrame) -> DataFrame:
    """Names eligible with a bar on each decision date."""
    live = study.filter("eligible").select(F.col("date").alias("decision_date"), "ticker")
    return live.join(decisions.select("schedule_id", "step", "decision_date"), "decision_date")


def normalise_weights(signals: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Positive finite weights, largest N per run and date, rescaled to one.

    ``limit`` is the largest max_positions of any run: a literal bound lets the
    ranking drop rows before its shuffle.
    """
    usable = signals.filter((F.col("weight") > 0) & (F.col("weight") < float("inf")))
    order = W.partitionBy("run_id", "decision_date").orderBy(F.col("weight").desc(), "signal_rank")
    top = usable.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= limit)
    top = top.join(runs.select("run_id", "max_positions"), "run_id").filter(F.col("_p") <= F.col("max_positions"))
    return rescale(top.select("run_id", "decision_date", "ticker", "weight"))


def rescale(weights: DataFrame) -> DataFrame:
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("run_id", "decision_date")))


def weight_changes(targets: DataFrame, run_steps: DataFrame) -> DataFrame:
    """Old and new target per name and step, from a union of each step with the one before."""
    last = run_steps.groupBy("run_id").agg(F.max("step").alias("_last"))
    shifted = (targets.join(last, "run_id").filter(F.col("step") < F.col("_last"))
               .select("run_id", (F.col("step") + 1).alias("step"), "ticker", F.col("weight").alias("from_w"),
                       F.lit(0.0).alias("to_w")))
    now = targets.select("run_id", "step", "ticker", F.lit(0.0).alias("from_w"), F.col("weight").alias("to_w"))
    both = now.unionByName(shifted).groupBy("run_id", "step", "ticker").agg(
        F.sum("from_w").alias("from_w"), F.sum("to_w").alias("to_w"))
    return both.withColumn("delta", F.abs(F.col("to_w") - F.col("from_w")))


def equity_steps(changes: DataFrame, run_steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Equity, cost and ruin per executed rebalance.

    The recurrence is nonlinear (fees round up and have floors and caps), so a
    run's rebalances are folded in order; the array is bounded by rebalances
    times twice the position limit.
    """
    per_step = changes.filter(F.col("delta") > MIN_TRADE).groupBy("run_id", "step").agg(
        F.array_sort(F.collect_list(F.struct("ticker", "delta"))).alias("_d"))
    ordered = (run_steps.select("run_id", "step").join(per_step, ["run_id", "step"], "left")
               .groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
                   "step", F.coalesce(F.col("_d.delta"), F.array().cast("array<double>")).alias("deltas")))).alias("_s")))
    step_type = "array<struct<step:int,equity_before:double,cost:double,charged:double,ruined:boolean>>"
    start = F.struct(F.col("capital").alias("equity"), F.lit(False).alias("over"),
                     F.array().cast(step_type).alias("done"))

    def fees(deltas: Column, equity: Column) -> Column:
        return F.aggregate(deltas, F.lit(0.0), lambda total, d: total + total_cost(
            d * equity, F.col("rate_pct"), F.col("min_fee"), F.col("sst"), F.col("spread_bps")))

    def trade(acc: Column, s: Column) -> Column:
        # the one-element array binds the fee sum so it is evaluated once
        def settle(state: Column, cost: Column) -> Column:
            equity = state["equity"]
            ruined = cost >= equity
            charged = F.when(ruined, equity).otherwise(cost)
            return F.struct(
                (equity - charged).alias("equity"), ruined.alias("over"),
                F.concat(state["done"], F.array(F.struct(
                    s["step"].alias("step"), equity.alias("equity_before"), cost.alias("cost"),
                    charged.alias("charged"), ruined.alias("ruined")))).alias("done"))
        return F.when(acc["over"], acc).otherwise(
            F.aggregate(F.array(fees(s["deltas"], acc["equity"])), acc, settle))

    folded = ordered.join(runs, "run_id").select("run_id", F.aggregate("_s", start, trade)["done"].alias("_done"))
    return folded.select("run_id", F.inline("_done")).join(run_steps, ["run_id", "step"])


def gross_returns(targets: DataFrame, run_steps: DataFrame, study: DataFrame) -> DataFrame:
    """Sum of weight times return per run and date; weights count from the day after the fill."""
    held = targets.join(run_steps.select("run_id", "step", "exec_idx", "next_exec_idx", "last_idx"), ["run_id", "step"])
    until = F.coalesce("next_exec_idx", "last_idx")
    days = (held.filter(until > F.col("exec_idx"))
            .select("run_id", "ticker", "weight", F.explode(F.sequence(F.col("exec_idx") + 1, until)).alias("date_idx")))
    bars = study.filter(F.col("ret").isNotNull()).select("ticker", "date_idx", "ret")
    # dealt by ticker like a stored study, which then is joined where it lies
    parts = getattr(study, "_ticker_buckets", None) or int(study.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = days.repartition(parts, "ticker")
    return (days.join(bars, ["ticker", "date_idx"]).groupBy("run_id", "date_idx")
            .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross")))


def run_backtests(study: DataFrame, cal: DataFrame, runs: DataFrame, decisions: DataFrame, signals: DataFrame,
                  max_positions: int, check_eligible: bool = True) -> BacktestResult:
    """Trade every run's signals.

    ``decisions`` comes from calendar.schedules; ``signals`` carries run_id.
    Signals built here choose among eligible names already, others are checked.
    """
    require_columns(study, ["date", "ticker", "date_idx", "ret", "eligible"], "study panel")
    if cal.limit(3).count() < 3:  # the calendar is one row per trading day
        raise ValueError("need at least 3 dates to backtest")
    run_steps = runs.select("run_id", "schedule_id").join(decisions, "schedule_id").drop("schedule_id")
    weights = normalise_weights(signals, runs, max_positions)
    if check_eligible:
        live = study.filter("eligible").select(F.col("date").alias("decision_date"), "ticker")
        weights = rescale(weights.join(live, ["decision_date", "ticker"], "left_semi"))
    targets = weights.join(run_steps.select("run_id", "step", "decision_date"), ["run_id", "decision_date"]).select(
        "run_id", "step", "ticker", "weight")
    # runs x rebalances x positions: small, and everything below reads it several times,
    # so the factor windows and ranks behind it run once
    targets = materialise(targets, "targets")
    changes = weight_changes(targets, run_steps)
    steps = materialise(equity_steps(changes, run_steps, runs), "steps")

    traded = changes.groupBy("run_id", "step").agg(F.sum("delta").alias("turnover"))
    turnover = (steps.select("run_id", "step", "exec_date").join(traded, ["run_id", "step"], "left")
                .withColumn("turnover", F.coalesce("turnover", F.lit(0.0))))
    fee_terms = runs.select("run_id", "rate_pct", "min_fee", "sst", "spread_bps")
    notional = F.col("delta") * F.col("equity_before")
    trades = (changes.filter(F.col("delta") > MIN_TRADE)
              .join(steps.select("run_id", "step", "exec_date", "equity_before"), ["run_id", "step"])
              .join(fee_terms, "run_id")
              .select("run_id", "step", "exec_date", "ticker", "from_w", "to_w", notional.alias("notional"),
                      total_cost(notional, F.col("rate_pct"), F.col("min_fee"), F.col("sst"),
                                 F.col("spread_bps")).alias("cost")))

    ruin = steps.filter("ruined").select("run_id", F.col("exec_idx").alias("ruin_idx"), F.col("exec_date").alias("ruined_on"))
    spans = run_steps.groupBy("run_id").agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))
    days = (spans.join(ruin, "run_id", "left")
            .select("run_id", "first_idx", "ruin_idx", F.explode(F.sequence("first_idx", "last_idx")).alias("date_idx"))
            .join(cal, "date_idx"))
    paid = steps.select("run_id", F.col("exec_idx").alias("date_idx"), (F.col("charged") / F.col("equity_before")).alias("_c"))
    day = (days.join(gross_returns(targets, run_steps, study), ["run_id", "date_idx"], "left")
           .join(paid, ["run_id", "date_idx"], "left").join(runs.select("run_id", "capital"), "run_id"))
    ruined = F.coalesce(F.col("date_idx") >= F.col("ruin_idx"), F.lit(False))
    ret = (F.when(ruined | (F.col("date_idx") == F.col("first_idx")), 0.0)
           .otherwise(F.coalesce("gross", F.lit(0.0)) - F.coalesce("_c", F.lit(0.0))))
    day = day.withColumn("ret", ret)
    so_far = W.partitionBy("run_id").orderBy("date_idx").rowsBetween(W.unboundedPreceding, 0)
    equity = F.when(ruined, 0.0).otherwise(F.col("capital") * F.product(1.0 + F.col("ret")).over(so_far))
    returns = day.select("run_id", "date", "date_idx", "ret", equity.alias("equity"))

    done = steps.groupBy("run_id").agg(F.sum("charged").alias("_paid"))
    summary = (run_steps.groupBy("run_id").agg(F.count("*").alias("n_rebalances"))
               .join(done, "run_id").join(turnover.groupBy("run_id").agg(F.avg("turnover").alias("avg_turnover")), "run_id")
               .join(runs.select("run_id", "capital"), "run_id").join(ruin.select("run_id", "ruined_on"), "run_id", "left")
               .select("run_id", "n_rebalances", (F.col("_paid") / F.col("capital")).alias("cost_drag"), "avg_turnover",
                       "ruined_on"))
    return BacktestResult(returns, targets, turnover, steps, trades, summary)


def run_signal(study: DataFrame, signal: Signal, cfg: BacktestConfig = BacktestConfig(), run_id: str = "strategy") -> BacktestResult:
    """One signal over all history.

    ``signal`` receives the study panel and the decision dates and returns
    decision_date, ticker, weight, signal_rank for all of them at once; it must
    read only bars up to each decision, as the factors here do.
    """
    cal = materialise(calendar(study), "calendar")
    decisions = materialise(schedules(cal, whole_history(cal, [cfg.rebalance])), "decisions")
    runs = rows(study.sparkSession, RUN_SCHEMA, [run_row(run_id, cfg.rebalance, cfg)])
    signals = signal(study, decisions).select(F.lit(run_id).alias("run_id"), "decision_date", "ticker", "weight", "signal_rank")
    return run_backtests(study, cal, runs, decisions, signals, cfg.max_positions)


def lookahead_report(panel: DataFrame, signal: Signal, cuts: list[str], rebalance: str = "ME",
                     prepare: Callable[[DataFrame], DataFrame] = lambda p: p) -> DataFrame:
    """Does a signal see the future?  One row per cut: decisions compared, decisions that differ, ``clean``.

    The signal runs on the whole panel and on the panel up to each cut (through ``prepare``, which builds the study from bars); what
    it decided on a date up to the cut has to be the same.  Decision dates are those of the whole calendar, so only the signal can differ.
    """
    whole = prepare(panel)
    cal = materialise(calendar(whole), "calendar")
    decisions = materialise(schedules(cal, whole_history(cal, [rebalance])), "decisions")
    keys = ["decision_date", "ticker"]

    def decided(study: DataFrame, known: DataFrame, name: str) -> DataFrame:
        return signal(study, known).select(*keys, F.struct("weight", "signal_rank").alias(name))

    full = materialise(decided(whole, decisions, "_full"), "signals")
    out = None
    for cut in cuts:
        known = decisions.filter(F.col("decision_date") <= F.lit(cut).cast("date"))
        part = decided(prepare(panel.filter(F.col("date") <= F.lit(cut).cast("date"))), known, "_cut")
        both = full.filter(F.col("decision_date") <= F.lit(cut).cast("date")).join(part, keys, "full")
        one = both.agg(F.count("*").alias("n_decisions"), F.count_if(~F.col("_full").eqNullSafe(F.col("_cut"))).alias("n_differ"))
        one = one.select(F.lit(cut).cast("date").alias("cut"), "n_decisions", "n_differ", (F.col("n_differ") == 0).alias("clean"))
        out = one if out is None else out.unionByName(one)
    return out
