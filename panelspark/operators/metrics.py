"""Performance statistics of many return series at once (run_id, date, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.stats import expected_max_sharpe, normal_cdf
from panelspark.schemas import PERIODS_PER_YEAR

def _so_far():
    return W.partitionBy("run_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)


def drawdowns(returns: DataFrame, start: float = 1.0) -> DataFrame:
    """Equity and drawdown per date; the peak starts at the first equity value."""
    eq = returns.withColumn("equity", F.lit(start) * F.product(1.0 + F.coalesce("ret", F.lit(0.0))).over(_so_far()))
    return eq.withColumn("drawdown", F.col("equity") / F.max("equity").over(_so_far()) - 1.0)


def probabilistic_z(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """z of the observed Sharpe against a benchmark; null when undefined."""
    spread = 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr
    return F.when((n >= 2) & (spread > 0), (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(spread))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability the true Sharpe exceeds a benchmark; 0 when undefined."""
    return F.coalesce(normal_cdf(probabilistic_z(sr, benchmark, n, skew, kurt)), F.lit(0.0))


def summarise(returns: DataFrame, rf: float = 0.0, n_trials: int = 1,
              periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """One row per run with every statistic; a run is one row per trading day."""
    present = drawdowns(returns.filter(F.col("ret").isNotNull()))
    excess = F.col("ret") - rf / periods
    a = present.groupBy("run_id").agg(
        F.count("*").alias("n_periods"), F.product(1.0 + F.col("ret")).alias("growth"),
        F.avg(excess).alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.count(F.when(excess < 0, excess)).alias("n_down"), F.stddev_samp(F.when(excess < 0, excess)).alias("sd_down"),
        F.min("drawdown").alias("max_dd"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3.0).alias("kurt"))
    year = F.sqrt(F.lit(float(periods)))
    n, growth, sd = F.col("n_periods"), F.col("growth"), F.col("sd")
    cagr = F.when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(float(periods)) / n) - 1.0)
    sharpe = F.when((n >= 2) & (sd > 0), F.col("mean") / sd * year).otherwise(0.0)
    sortino = F.when((n >= 2) & (F.col("n_down") >= 2) & (F.col("sd_down") > 0),
                     F.col("mean") / F.col("sd_down") * year).otherwise(0.0)
    flat = (sd < 1e-12) | F.isnan("skew") | F.isnan("kurt") | F.col("skew").isNull() | F.col("kurt").isNull()
    out = a.select(
        "run_id", "n_periods", (growth - 1.0).alias("total_return"), cagr.alias("cagr"),
        F.when(n >= 2, sd * year).otherwise(0.0).alias("vol"), sharpe.alias("sharpe"), sortino.alias("sortino"),
        "max_dd", F.when(F.col("max_dd") < 0, cagr / F.abs("max_dd")).otherwise(0.0).alias("calmar"), "hit_rate",
        F.when(flat, 0.0).otherwise(F.col("skew")).alias("skew"), F.when(flat, 3.0).otherwise(F.col("kurt")).alias("kurt"))
    return deflate(out, n_trials, periods) if n_trials > 1 else out


def deflate(stats: DataFrame, n_trials: int, periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """Probability the true Sharpe is positive after ``n_trials`` attempts; 0 when undefined."""
    n = F.col("n_periods")
    sr = F.col("sharpe") / F.sqrt(F.lit(float(periods)))
    z = probabilistic_z(sr, expected_max_sharpe(n_trials, 1.0 / (n - 1)), n, F.col("skew"), F.col("kurt"))
    z = F.when(n >= 3, z)
    return stats.withColumn("dsr_z", z).withColumn("dsr", F.coalesce(normal_cdf(F.col("dsr_z")), F.lit(0.0)))


def compare(stats: DataFrame, turnover: DataFrame | None = None) -> DataFrame:
    """Side-by-side table of runs, one row each."""
    out = stats.withColumnRenamed("run_id", "strategy")
    return out if turnover is None else out.join(turnover.withColumnRenamed("run_id", "strategy"), "strategy", "left")
