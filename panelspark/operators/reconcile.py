"""Agreement between two sources of the same bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.functions.prices import row_return
from panelspark.operators.timejoin import within_days

CLOSE_TOL = 0.005
ADJ_TOL = 0.02
MATERIAL = 0.10


def aligned(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """Both sources side by side: all bars, or those that both have (``how`` inner)."""
    cols = ["ticker", "date", "close", "adj_close"]
    left = a.select(*cols, F.lit(True).alias("in_a"))
    right = b.select("ticker", "date", F.col("close").alias("close_b"), F.col("adj_close").alias("adj_close_b"),
                     F.lit(True).alias("in_b"))
    both = left.join(right, ["ticker", "date"], how)
    diff = lambda x, y: F.abs(F.try_divide(F.col(x), F.col(y)) - 1.0)
    return both.select(
        "*", diff("close", "close_b").alias("close_diff"), diff("adj_close", "adj_close_b").alias("adj_diff"))


def compare_panels(a: DataFrame, b: DataFrame, close_tol: float = CLOSE_TOL, adj_tol: float = ADJ_TOL) -> DataFrame:
    """One row per shared ticker: overlap, worst gaps, mismatches, verdicts."""
    both = F.col("in_a") & F.col("in_b")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = aligned(a, b).groupBy("ticker").agg(
        F.count("in_a").alias("_na"), F.count("in_b").alias("_nb"),
        n(both).alias("common_bars"), n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"),
        F.coalesce(F.max("close_diff"), F.lit(0.0)).alias("max_close_diff"),
        F.coalesce(F.max("adj_diff"), F.lit(0.0)).alias("max_adj_diff"),
        n(F.col("close_diff") > close_tol).alias("close_mismatches"),
        n(F.col("adj_diff") > adj_tol).alias("adj_mismatches")).filter("_na > 0 and _nb > 0").drop("_na", "_nb")
    return out.select(
        "*", ((F.col("close_mismatches") == 0) & (F.col("adj_mismatches") == 0)).alias("clean"),
        (F.greatest("max_close_diff", "max_adj_diff") > MATERIAL).alias("material"))


def worst_rows(a: DataFrame, b: DataFrame, k: int = 5, close_tol: float = CLOSE_TOL, adj_tol: float = ADJ_TOL) -> DataFrame:
    """Top k mismatching bars per ticker: by adjusted gap where there is one, else by close gap."""
    rows = aligned(a, b, "inner").select(  # a gap needs both
        "*", F.max((F.col("adj_diff") > adj_tol).cast("int")).over(W.partitionBy("ticker")).alias("_adj"))
    by_adj = F.coalesce(F.col("_adj"), F.lit(0)) == 1
    rows = rows.select("ticker", "date", "close_diff", "adj_diff",
                       F.when(by_adj, F.col("adj_diff")).otherwise(F.col("close_diff")).alias("diff"),
                       F.when(by_adj, adj_tol).otherwise(close_tol).alias("_tol"))
    order = W.partitionBy("ticker").orderBy(F.col("diff").desc(), "date")
    return (rows.filter(F.col("diff") > F.col("_tol")).withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= k).drop("_tol"))


def splits_missing(panel: DataFrame, events: DataFrame, tol: float = 0.05,
                   invert_consolidations: bool = False) -> DataFrame:
    """Whether each recorded split is visible as a step nobody adjusted.

    The implied ratio is at least one, so a consolidation (value below one) is
    only ever matched with ``invert_consolidations``.
    """
    bars = panel.select("ticker", F.col("date").alias("bar_date"), row_return().alias("adj_ret")).filter(
        F.col("adj_ret").isNotNull())
    ev = events.select("ticker", "date", "value")
    near = within_days(bars, ev, "ticker", "bar_date", "date", 45, 5)
    step = near.groupBy("ticker", "date", "value").agg(
        F.max_by("adj_ret", F.struct(F.abs("adj_ret"), -F.unix_date("bar_date"))).alias("adj_step"))
    implied = F.when(F.col("adj_step") < 0, F.try_divide(F.lit(1.0), 1.0 + F.col("adj_step"))).otherwise(1.0 + F.col("adj_step"))
    target = F.when(F.col("value") < 1.0, 1.0 / F.col("value")).otherwise(F.col("value")) if invert_consolidations else F.col("value")
    stepped = F.coalesce(F.abs(implied - target) / target < tol, F.lit(False))
    return step.select("ticker", "date", F.col("value").alias("ratio"), "adj_step", (~stepped).alias("applied"))


def quote_agreement(a: DataFrame, b: DataFrame, tol: float = CLOSE_TOL) -> DataFrame:
    """Two feeds' latest quotes (ticker, price): relative gap and whether it is within tolerance."""
    gap = F.abs(F.try_divide(F.col("price"), F.col("price_b")) - 1.0)
    return (a.select("ticker", "price").join(b.select("ticker", F.col("price").alias("price_b")), "ticker")
            .select("*", gap.alias("gap"), F.coalesce(gap <= tol, F.lit(False)).alias("agrees")))
