"""Opponents a ranking has to beat: broad baskets and matched random picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.costs import broker_breadth
from panelspark.functions.draws import sample_positions
from panelspark.operators import metrics
from panelspark.operators.backtest import BacktestResult, eligible_on, RUN_COLUMNS, RUN_SCHEMA, run_backtests, run_row
from panelspark.operators.calendar import calendar, schedules, whole_history
from panelspark.operators.factors import Strategy, composite_scores, factor_values, percentile_ranks, top_n
from panelspark.operators.literals import rows, setting_rows
from panelspark.operators.ordering import exact_quantiles, ordinal, running_sum
from panelspark.schemas import BacktestConfig
from panelspark.scratch import materialise


def strategy_signals(study: DataFrame, strategies, dates: DataFrame) -> DataFrame:
    """Equal weight across each strategy's top names on the decision dates (date, first_idx)."""
    names = sorted({f for s in strategies for f, _ in s.weights})
    ranked = percentile_ranks(factor_values(study, names, dates), names)
    picks = top_n(composite_scores(ranked, strategies), strategies)
    return picks.select("strategy", "first_idx", F.col("date").alias("decision_date"), "ticker", F.lit(1.0).alias("weight"),
                        F.format_string("%06d", "place").alias("signal_rank"))


def broad_signals(live: DataFrame, runs: DataFrame) -> DataFrame:
    """Weight one on every eligible name, in ticker order."""
    return live.join(runs.select("run_id", "schedule_id"), "schedule_id").select(
        "run_id", "decision_date", "ticker", F.lit(1.0).alias("weight"), F.col("ticker").alias("signal_rank"))


def random_signals(live: DataFrame, schedule_id: str, n_trials: int, n_names: int, seed: int) -> DataFrame:
    """``n_names`` eligible names without replacement per trial and decision.

    Positions are drawn first and joined to the numbered names, so the work is
    trials times positions plus one pass over the names, not trials times names.
    """
    mine = live.filter(F.col("schedule_id") == schedule_id)
    numbered = ordinal(mine, ["decision_date"], [F.col("ticker")], "pos", "m")
    numbered = numbered.select("decision_date", "ticker", "pos", "m")
    sizes = mine.groupBy("decision_date").agg(F.count("*").alias("m"))
    trials = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_trials - 1).cast("bigint"))).alias("trial")
    draws = sizes.select("*", trials).select(
        F.concat(F.lit("random_"), F.col("trial").cast("string")).alias("run_id"), "decision_date",
        F.explode(sample_positions(F.col("m"), n_names, F.lit(seed), F.col("trial"), F.col("decision_date"))).alias("pos"))
    return draws.join(numbered.drop("m"), ["decision_date", "pos"]).select(
        "run_id", "decision_date", "ticker", F.lit(1.0).alias("weight"), F.col("ticker").alias("signal_rank"))


def random_trials(study: DataFrame, cfg: BacktestConfig, n_names: int, n_trials: int = 200, seed: int = 0,
                  measure_from: str | None = None) -> DataFrame:
    """One row of statistics per random run; scoring may start later than trading."""
    result = random_backtests(study, cfg, n_names, n_trials, seed)
    stats = metrics.summarise(scored_from(result.returns, measure_from))
    return stats.select(F.substring("run_id", 8, 20).cast("int").alias("trial"), "total_return", "cagr", "sharpe", "max_dd", "vol")


def scored_from(returns: DataFrame, start: str | None) -> DataFrame:
    return returns if start is None else returns.filter(F.col("date") >= F.lit(start).cast("date"))


def random_backtests(study: DataFrame, cfg: BacktestConfig, n_names: int, n_trials: int, seed: int) -> BacktestResult:
    spark = study.sparkSession
    cal = materialise(calendar(study), "calendar")
    decisions = materialise(schedules(cal, whole_history(cal, [cfg.rebalance])), "decisions")
    live = eligible_on(study, decisions)
    row = run_row("", cfg.rebalance, cfg)
    runs = _trial_runs(spark, n_trials, row, n_names)
    signals = random_signals(live, cfg.rebalance, n_trials, n_names, seed)
    return run_backtests(study, cal, runs, decisions, signals, n_names, check_eligible=False)


def _trial_runs(spark, n_trials: int, row: tuple, n_names: int) -> DataFrame:
    settings = setting_rows(RUN_SCHEMA, [(*row[:-1], n_names)])[0]
    return spark.range(n_trials).select(F.concat(F.lit("random_"), F.col("id").cast("string")).alias("_id"), settings.alias("s")).select(
        F.col("_id").alias("run_id"), *[F.col(f"s.{c}").alias(c) for c in RUN_COLUMNS[1:]])


def percentile_vs_random(value: DataFrame, randoms: DataFrame) -> DataFrame:
    """100 times the share of random values strictly below each strategy value (run_id, value)."""
    one = F.lit(1).alias("g")
    drawn = randoms.filter(F.col("value").isNotNull()).select(one, F.lit(None).cast("string").alias("run_id"), "value", F.lit(1).cast("bigint").alias("w"))
    asked = value.select(one, "run_id", "value", F.lit(0).cast("bigint").alias("w"))
    # A strategy comes before the trials that equal it, so what is summed before it lies strictly below.
    placed = running_sum(asked.unionByName(drawn), ["g"], ["value", "w", "run_id"], F.col("w"), "below", "n")
    return placed.filter("w = 0").select("run_id", F.try_divide(F.col("below") * 100.0, F.col("n")).alias("pctile_vs_random"))


def baseline_runs(study: DataFrame, strategy: Strategy, cfg: BacktestConfig, n_random: int, n_names: int,
                  seed: int = 0) -> BacktestResult:
    """Strategy, buy and hold, equal weight and all random trials as one job."""
    spark = study.sparkSession
    cal = materialise(calendar(study), "calendar")
    decisions = materialise(schedules(cal, whole_history(cal, sorted({cfg.rebalance, "YE"}))), "decisions")
    breadth = broker_breadth(cfg.capital, cfg.broker)
    base = run_row("", cfg.rebalance, cfg)
    named = rows(spark, RUN_SCHEMA, [
        (strategy.name, *base[1:]),
        ("buy & hold", "YE", *base[2:-1], breadth),
        ("equal weight", *base[1:-1], breadth)])
    runs = named.unionByName(_trial_runs(spark, n_random, base, n_names))
    live = eligible_on(study, decisions)
    mine = decisions.filter(F.col("schedule_id") == cfg.rebalance).select(F.col("decision_date").alias("date"), "first_idx")
    signals = (strategy_signals(study, [strategy], mine).withColumnRenamed("strategy", "run_id").drop("first_idx")
               .unionByName(broad_signals(live, named.filter(F.col("run_id").isin("buy & hold", "equal weight"))))
               .unionByName(random_signals(live, cfg.rebalance, n_random, n_names, seed)))
    return run_backtests(study, cal, runs, decisions, signals, max(breadth, cfg.max_positions, n_names), check_eligible=False)


def baseline_table(study: DataFrame, strategy: Strategy, cfg: BacktestConfig = BacktestConfig(), n_random: int = 100,
                   n_names: int = 3, seed: int = 0) -> DataFrame:
    """Four rows: strategy, two baskets, median of random; and the strategy's percentile among the random."""
    result = baseline_runs(study, strategy, cfg, n_random, n_names, seed)
    shown = ["total_return", "cagr", "vol", "sharpe", "max_dd"]
    stats = materialise(metrics.summarise(result.returns).select("run_id", *shown).join(
        result.summary.select("run_id", "avg_turnover", "cost_drag"), "run_id"), "stats")  # one row per run
    is_random = F.col("run_id").startswith("random_")
    randoms = stats.filter(is_random)
    long = randoms.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in shown])).alias("x"))
    mids = exact_quantiles(long.select("x.*"), ["stat"], "value", {"mid": 0.5})
    median = mids.agg(*[F.max(F.when(F.col("stat") == c, F.col("mid"))).alias(c) for c in shown]).withColumn(
        "run_id", F.lit("random entry (median)"))
    place = percentile_vs_random(stats.filter(F.col("run_id") == strategy.name).select("run_id", F.col("sharpe").alias("value")),
                                 randoms.select(F.col("sharpe").alias("value")))
    none = F.lit(None).cast("double")
    table = stats.filter(~is_random).unionByName(
        median.select("run_id", *shown, none.alias("avg_turnover"), none.alias("cost_drag")))
    return table.join(place, "run_id", "left").withColumnRenamed("run_id", "strategy")
