"""What happened next to each factor bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.prices import by_ticker, change, row_return
from panelspark.scratch import materialise
from panelspark.operators.ordering import exact_quantiles, ordinal

THIN = 100
QUANTILES = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def add_factor(panel: DataFrame, factor: str = "momentum", lookback: int = 60, price: str = "adj_close") -> DataFrame:
    """A factor from the ticker's own last bars."""
    p = F.col(price)
    if factor in ("momentum", "reversal"):
        value = change(p, F.lag(price, lookback).over(by_ticker()))
        return panel.withColumn("factor", value if factor == "momentum" else -value)
    if factor in ("volatility", "high_vol"):
        w = by_ticker().rowsBetween(-(lookback - 1), 0)
        returns = panel.withColumn("_r", row_return(price))
        full = F.count("_r").over(w) == lookback
        return returns.withColumn("factor", F.when(full, F.stddev_samp("_r").over(w))).drop("_r")
    raise ValueError(f"unknown factor {factor!r}")


def forward_returns(panel: DataFrame, horizon: int = 21, price: str = "adj_close") -> DataFrame:
    """Return from the next bar to ``horizon`` bars after it."""
    entry, leave = F.lead(price, 1).over(by_ticker()), F.lead(price, 1 + horizon).over(by_ticker())
    return panel.withColumn("fwd_return", change(leave, entry))


def bucket_cross_sectionally(panel: DataFrame, n_buckets: int = 10) -> DataFrame:
    """Rank each date's eligible names against each other and cut into equal buckets."""
    rows = panel.filter("eligible") if "eligible" in panel.columns else panel
    rows = rows.filter(F.col("factor").isNotNull() & F.col("fwd_return").isNotNull())
    ranked = ordinal(rows, ["date"], [F.col("factor"), F.col("ticker")], "_rn", "_m")
    bucket = F.greatest(F.lit(1), F.expr(f"((_rn - 1) * {n_buckets} + _m - 2) div (_m - 1)").cast("int"))
    return ranked.filter(F.col("_m") >= 2 * n_buckets).withColumn("bucket", bucket).drop("_rn", "_m")


def summarise_buckets(bucketed: DataFrame, horizon: int = 21) -> DataFrame:
    """Distribution of forward returns per bucket, with the number of independent periods."""
    # three narrow columns, read by the counts and by the quantiles: the windows behind them run once
    bucketed = materialise(bucketed.select("bucket", "date", "fwd_return"), "buckets")
    r = F.col("fwd_return")
    per_date = bucketed.groupBy("bucket", "date").agg(
        F.count("*").alias("n"), F.sum(r).alias("s"), F.sum((r > 0).cast("bigint")).alias("up"),
        F.sum((r > 0.20).cast("bigint")).alias("g20"), F.sum((r < -0.20).cast("bigint")).alias("l20"),
        F.sum((r < -0.30).cast("bigint")).alias("l30"))
    n = F.sum("n")
    stats = per_date.groupBy("bucket").agg(
        n.alias("n"), (F.count("*") / horizon).alias("independent_periods"), (F.sum("s") / n).alias("mean"),
        (F.sum("up") / n).alias("p_positive"), (F.sum("g20") / n).alias("p_gain_20"),
        (F.sum("l20") / n).alias("p_loss_20"), (F.sum("l30") / n).alias("p_loss_30"))
    places = exact_quantiles(bucketed, ["bucket"], "fwd_return", QUANTILES)
    return stats.join(places, "bucket").withColumn("thin", F.col("n") < THIN)


def base_rates(panel: DataFrame, factor: str = "momentum", horizon: int = 21, lookback: int = 60,
               n_buckets: int = 10) -> DataFrame:
    ready = forward_returns(add_factor(panel, factor, lookback), horizon)
    return summarise_buckets(bucket_cross_sectionally(ready, n_buckets), horizon)


def current_buckets(panel: DataFrame, as_of: DataFrame, factor: str = "momentum", lookback: int = 60,
                    n_buckets: int = 10) -> DataFrame:
    """Rank, bucket and percentile of every eligible name on the one ``as_of`` date."""
    today = add_factor(panel, factor, lookback).filter(F.col("date") == as_of.select("as_of").scalar())
    if "eligible" in panel.columns:
        today = today.filter("eligible")
    today = today.filter(F.col("factor").isNotNull())
    ranked = ordinal(today, ["date"], [F.col("factor").desc(), F.col("ticker")], "rank", "n_universe")
    above = F.col("n_universe") - F.col("rank") + 1
    bucket = F.greatest(F.lit(1), F.ceil(above / F.col("n_universe") * n_buckets).cast("int"))
    return ranked.select("date", "ticker", "rank", "n_universe", bucket.alias("bucket"),
                         F.col("factor").alias("factor_value"), (above / F.col("n_universe")).alias("percentile"))


def locate(buckets: DataFrame, ticker: str, as_of: DataFrame) -> DataFrame:
    """One ticker's standing as a row that says why when it is not found."""
    mine = buckets.filter(F.col("ticker") == ticker)
    sizes = buckets.groupBy(F.col("date").alias("as_of")).agg(F.count("*").alias("n_names"))
    out = as_of.join(sizes, "as_of", "left").join(mine.withColumnRenamed("date", "as_of"), "as_of", "left")
    reason = (F.when(F.col("n_names").isNull(), "no eligible names")
              .when(F.col("ticker").isNull(), "not eligible on this date"))
    return out.select(F.lit(ticker).alias("wanted"), "as_of", F.col("ticker").isNotNull().alias("found"),
                      reason.alias("reason"), "n_names", "rank", "bucket", "factor_value", "percentile")


def decile_report(buckets: DataFrame, rates: DataFrame) -> DataFrame:
    """Today's names next to the history of their bucket."""
    return buckets.join(rates, "bucket")
