"""The shared trading calendar and the dates on which portfolios are rebalanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct panel dates with a 0-based index.

    Distinct dates are found by partial aggregation; the sorted array holds one
    entry per trading day, however many rows the panel has.
    """
    dates = panel.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    return dates.select(F.posexplode("dates").alias("date_idx", "date"))


def period_key(date: Column, rule: str) -> Column:
    """The period a date falls in: calendar month, year, or week ending Friday."""
    if rule == "ME":
        return F.trunc(date, "month")
    if rule == "YE":
        return F.trunc(date, "year")
    if rule == "W-FRI":
        return F.next_day(F.date_sub(date, 1), "FRI")
    raise ValueError(f"unknown rebalance rule {rule!r}: use ME, W-FRI or YE")


def schedules(cal: DataFrame, specs: DataFrame, rules: tuple[str, ...] = ("ME", "W-FRI", "YE")) -> DataFrame:
    """Decision and fill dates per schedule.

    ``specs`` has schedule_id, rule and half-open start/end dates (end may be
    null).  A schedule decides on the last panel date of every period and on its
    very first date, never on its last one, and fills on the next panel date.
    The result is the size of the calendar times the number of schedules.
    """
    key = F.lit(None).cast("date")
    for rule in rules:
        key = F.when(F.col("rule") == rule, period_key(F.col("date"), rule)).otherwise(key)
    days = (cal.join(specs, (F.col("date") >= F.col("start"))
                     & (F.col("end").isNull() | (F.col("date") < F.col("end"))))
            .select("schedule_id", "rule", "date", "date_idx"))
    whole = W.partitionBy("schedule_id")
    ordered = whole.orderBy("date")
    days = days.select(
        "*",
        F.max("date").over(W.partitionBy("schedule_id", key)).alias("_last"),
        F.min("date").over(whole).alias("_first"),
        F.min("date_idx").over(whole).alias("first_idx"),
        F.max("date_idx").over(whole).alias("last_idx"),
        F.lead("date").over(ordered).alias("exec_date"),
        F.lead("date_idx").over(ordered).alias("exec_idx"))
    picked = days.filter(((F.col("date") == F.col("_last")) | (F.col("date") == F.col("_first")))
                         & F.col("exec_date").isNotNull())
    return picked.select(
        "schedule_id",
        (F.row_number().over(ordered) - 1).alias("step"),
        F.col("date").alias("decision_date"), F.col("date_idx").alias("decision_idx"),
        "exec_date", "exec_idx", "first_idx", "last_idx",
        F.lead("exec_idx").over(ordered).alias("next_exec_idx"))


def whole_history(cal: DataFrame, rules: list[str]) -> DataFrame:
    """Whole-history schedules, one per rebalance rule and named after it."""
    first = cal.agg(F.min("date").alias("start"))
    return first.select("start", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule")).select(
        F.col("rule").alias("schedule_id"), "rule", "start", F.lit(None).cast("date").alias("end"))


def rebalance_dates(panel: DataFrame, rule: str) -> DataFrame:
    cal = calendar(panel)
    return schedules(cal, whole_history(cal, [rule])).select("step", "decision_date", "exec_date")
