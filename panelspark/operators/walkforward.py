"""Walk-forward selection: choose on the training window, score on the next one."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators import metrics
from panelspark.operators.backtest import RUN_COLUMNS, RUN_SCHEMA, run_backtests, run_row
from panelspark.operators.baselines import strategy_signals
from panelspark.operators.calendar import calendar, schedules
from panelspark.operators.literals import setting_rows
from panelspark.schemas import BacktestConfig
from panelspark.scratch import materialise

MIN_DATES = 100
MIN_TRAIN, MIN_TEST, MIN_HOLDOUT = 60, 10, 20
MIN_MEANINGFUL_IS = 0.20


class WalkForward(NamedTuple):
    folds: DataFrame        # one row per fold with the choice and both Sharpes
    candidates: DataFrame   # fold, strategy, train statistics
    oos: DataFrame          # stitched out-of-sample returns
    summary: DataFrame


def holdout_start(cal: DataFrame, months: int) -> Column:
    """The first date no fold may see, as a scalar."""
    return cal.agg(F.add_months(F.max("date"), -months)).scalar()


def _require(cal: DataFrame, holdout_months: int) -> None:
    """Two numbers reach the driver: dates in all and before the holdout."""
    n = cal.withColumn("_h", holdout_start(cal, holdout_months)).agg(
        F.count("*").alias("n"), F.sum((F.col("date") < F.col("_h")).cast("int")).alias("usable")).first()
    if n.n < MIN_DATES:
        raise ValueError("not enough history to walk forward")
    if n.usable < MIN_DATES:
        raise ValueError(f"a holdout of {holdout_months} months leaves too little history")


def make_splits(cal: DataFrame, n_folds: int = 5, train_months: int = 24, test_months: int = 6,
                expanding: bool = True, holdout_months: int = 12) -> DataFrame:
    """Half-open train and test windows stepping back from the last usable date."""
    _require(cal, holdout_months)
    usable = cal.withColumn("holdout_start", holdout_start(cal, holdout_months)).filter(F.col("date") < F.col("holdout_start"))
    span = usable.groupBy("holdout_start").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    k = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("k"))
    k = k.withColumn("test_end", F.add_months("last", -test_months * F.col("k")))
    k = k.withColumn("test_start", F.add_months("test_end", -test_months))
    start = F.col("first") if expanding else F.greatest("first", F.add_months("test_start", -train_months))
    k = k.withColumn("train_start", start).filter(
        F.date_diff("test_start", "train_start") >= train_months * 30 * 0.6)
    fold = F.row_number().over(W.partitionBy("holdout_start").orderBy(F.col("k").desc()))
    return k.select(fold.alias("fold"), "train_start", F.col("test_start").alias("train_end"), "test_start", "test_end",
                    "holdout_start")


def usable_folds(cal: DataFrame, splits: DataFrame) -> DataFrame:
    inside = cal.join(splits, (F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("test_end")))
    n = lambda c: F.sum(c.cast("int"))
    counted = inside.groupBy(*splits.columns).agg(
        n(F.col("date") < F.col("train_end")).alias("_train"), n(F.col("date") >= F.col("test_start")).alias("_test"))
    return counted.filter((F.col("_train") >= MIN_TRAIN) & (F.col("_test") >= MIN_TEST)).drop("_train", "_test")


def _runs(folds: DataFrame, strategies, cfg: BacktestConfig, key: Column) -> DataFrame:
    """One run per fold and strategy; its schedule is the fold's window."""
    settings = setting_rows("strategy STRING, " + RUN_SCHEMA, [(s.name, *run_row("", "", cfg)) for s in strategies])
    return folds.select("*", F.inline(settings)).withColumns({
        "run_id": F.concat_ws("|", key, "fold", "strategy"), "schedule_id": F.concat_ws("|", key, "fold")})


class _Choices(NamedTuple):
    """Decisions of every window and what each strategy would hold on them."""

    cal: DataFrame
    decisions: DataFrame
    signals: DataFrame


def _choices(study: DataFrame, cal: DataFrame, windows: DataFrame, strategies) -> _Choices:
    """Factors and ranks once for all windows; a decision needs its history inside its own window."""
    decisions = materialise(schedules(cal, windows), "decisions")
    dates = decisions.select(F.col("decision_date").alias("date"), "first_idx")
    return _Choices(cal, decisions, materialise(strategy_signals(study, strategies, dates), "signals"))


def _backtest(study: DataFrame, choices: _Choices, runs: DataFrame, cfg: BacktestConfig):
    mine = runs.select("run_id", "schedule_id", "strategy").join(
        choices.decisions.select("schedule_id", "decision_date", "first_idx"), "schedule_id")
    chosen = mine.join(choices.signals, ["strategy", "decision_date", "first_idx"]).select(
        "run_id", "decision_date", "ticker", "weight", "signal_rank")
    return run_backtests(study, choices.cal, runs.select(*RUN_COLUMNS), choices.decisions, chosen, cfg.max_positions,
                         check_eligible=False)


def _window(folds: DataFrame, key: str, rule: str, start: str, end: Column) -> DataFrame:
    return folds.select(F.concat_ws("|", F.lit(key), "fold").alias("schedule_id"), F.lit(rule).alias("rule"),
                        F.col(start).alias("start"), end.alias("end"))


def walk_forward(study: DataFrame, strategies, cfg: BacktestConfig = BacktestConfig(), n_folds: int = 5,
                 train_months: int = 24, test_months: int = 6, expanding: bool = True, holdout_months: int = 12) -> WalkForward:
    """Every strategy on every training window in one job, the chosen ones through their test windows in a second.

    With rolling windows the history a factor may use starts with the window; the
    zero returns of a name's dates before its first bar in the window are the one
    thing not restarted.
    """
    cal = materialise(calendar(study), "calendar")
    splits = make_splits(cal, n_folds, train_months, test_months, expanding, holdout_months)
    folds = materialise(usable_folds(cal, splits), "folds")
    first = cal.agg(F.min("date")).scalar()
    windows = _window(folds, "train", cfg.rebalance, "train_start", F.col("train_end")).unionByName(
        _window(folds.withColumn("_first", first), "test", cfg.rebalance, "_first", F.col("test_end")))
    choices = _choices(study, cal, windows, strategies)

    train = _runs(folds, strategies, cfg, F.lit("train"))
    fitted = metrics.summarise(_backtest(study, choices, train, cfg).returns)
    candidates = materialise(train.select("run_id", "fold", "strategy").join(fitted, "run_id").select(
        "fold", "strategy", F.col("sharpe").alias("train_sharpe"), F.col("total_return").alias("train_return")), "candidates")
    best = W.partitionBy("fold").orderBy(F.col("train_sharpe").desc_nulls_last(), "strategy")
    chosen = candidates.withColumn("_p", F.row_number().over(best)).filter("_p = 1").drop("_p")

    # only the chosen runs are traded in the second pass
    test = _runs(folds, strategies, cfg, F.lit("test")).join(chosen.select("fold", "strategy"), ["fold", "strategy"], "left_semi")
    out = _backtest(study, choices, test, cfg).returns
    scored = materialise(out.join(test.select("run_id", "fold", "test_start"), "run_id").filter(F.col("date") >= F.col("test_start"))
                         .select("run_id", "fold", "date", "ret"), "oos")
    oos_stats = metrics.summarise(scored).join(test.select("run_id", "fold"), "run_id").select(
        "fold", F.col("sharpe").alias("oos_sharpe"), F.col("total_return").alias("oos_return"), F.col("max_dd").alias("oos_maxdd"))
    table = folds.join(chosen, "fold").join(oos_stats, "fold").select(
        "fold", "train_start", "train_end", "test_start", "test_end", F.col("strategy").alias("chosen"),
        F.col("train_sharpe").alias("is_sharpe"), "oos_sharpe", "oos_return", "oos_maxdd")
    stitched = scored.groupBy("date").agg(F.min_by("ret", "fold").alias("ret"))
    return WalkForward(table, candidates, stitched, _summary(table, stitched))


def _summary(folds: DataFrame, stitched: DataFrame) -> DataFrame:
    """Mean Sharpes, survival ratio (null without an in-sample edge), stitched statistics."""
    means = folds.agg(F.avg("is_sharpe").alias("mean_is"), F.avg("oos_sharpe").alias("mean_oos"),
                      (F.countDistinct("chosen") == 1).alias("always_same_choice"))
    ratio = F.when(F.col("mean_is") >= MIN_MEANINGFUL_IS, F.col("mean_oos") / F.col("mean_is"))
    whole = metrics.summarise(stitched.select(F.lit("oos").alias("run_id"), "date", "ret")).select(
        F.col("sharpe").alias("stitched_sharpe"), F.col("total_return").alias("stitched_return"),
        F.col("max_dd").alias("stitched_maxdd"))
    return means.select("*", ratio.alias("degradation"), whole.select(F.struct("*")).scalar().alias("_w")).select("*", "_w.*").drop("_w")


def evaluate_holdout(study: DataFrame, strategy, cfg: BacktestConfig = BacktestConfig(), holdout_months: int = 12,
                     n_trials: int = 1) -> DataFrame:
    """One strategy over all history, scored on the final months only."""
    cal = materialise(calendar(study), "calendar")
    begins = holdout_start(cal, holdout_months)
    held = cal.filter(F.col("date") >= begins)
    span = held.agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end")).first()  # one row
    if span.n < MIN_HOLDOUT:
        raise ValueError("holdout too short to evaluate")
    folds = cal.agg(F.min("date").alias("_f")).select(F.lit(1).alias("fold"), "_f")
    runs = _runs(folds, [strategy], cfg, F.lit("holdout"))
    window = _window(folds, "holdout", cfg.rebalance, "_f", F.lit(None).cast("date"))
    out = _backtest(study, _choices(study, cal, window, [strategy]), runs, cfg).returns
    kept = out.filter(F.col("date") >= F.lit(span.start))
    stats = metrics.summarise(kept.select("run_id", "date", "ret"))
    stats = metrics.deflate(stats, n_trials)
    return stats.select(
        F.lit(span.start).alias("start"), F.lit(span.end).alias("end"), F.lit(strategy.name).alias("strategy"), "sharpe", "total_return", "max_dd", "dsr_z", "dsr",
        F.lit(n_trials).alias("n_trials_declared"))
