"""What a task holds follows the size of the tables, and the results do not."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelspark import scratch
from panelspark.functions.prices import add_median, add_returns, by_ticker, framed_median
from panelspark.operators import factors
from panelspark.operators.ordering import average_rank_pcts
from panelspark.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _differ(a, b) -> int:
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def test_study_has_more_buckets_for_a_larger_table(spark, monkeypatch):
    wanted = ["date", "ticker", "close", "adj_close", "volume", "median_dtv", "eligible", "date_idx", "ret"]
    scratch.forget_stored(spark)
    few = scratch.materialise(tables.stored_study(spark, SF).select(*wanted), "few")
    scratch.forget_stored(spark)
    monkeypatch.setattr(scratch, "PARTITION_BYTES", 16 << 10)
    parts = tables.line_partitions(spark, SF)
    study = tables.stored_study(spark, SF)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = add_returns(study.drop("ret"))
    assert study._ticker_buckets == parts == by_bucket.rdd.getNumPartitions() and "Exchange" not in _plan(by_bucket)
    assert _differ(few, study.select(*wanted)) == 0
    scratch.forget_stored(spark)


def test_bars_of_lines_sort_no_split_of_the_table(spark):
    plan = _plan(tables.weekly_bars(spark, SF))
    below = plan[plan.index("REPARTITION_BY_NUM"):]  # what runs before the lines are dealt
    assert "SortAggregate" in plan and "Aggregate" not in below and "Sort" not in below
    combined = tables.line_bars(tables.line_ticks(tables.table(spark, SF, "lineitem")))
    assert _differ(combined, tables.weekly_bars(spark, SF)) == 0


def test_hot_bar_and_repeated_lines_make_the_same_bars(spark):
    lines = tables.table(spark, SF, "lineitem")
    same_bar = {"l_suppkey": F.lit(1).cast("bigint"), "l_shipdate": F.lit("1996-02-07").cast(lines.schema["l_shipdate"].dataType)}
    hot = lines.unionByName(lines.limit(400).withColumns(same_bar))
    ticks = tables.line_ticks(hot.unionByName(hot))
    assert _differ(tables.line_bars(ticks), tables.line_bars(ticks, parts=7)) == 0


def test_framed_median_has_the_bits_of_percentile(spark):
    value = F.when(F.col("id") % 7 != 0, F.round(F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 9), 5))
    panel = spark.range(4000).select((F.col("id") % 11).cast("string").alias("ticker"), F.col("id").alias("date"), value.alias("v"))
    for rows in (1, 2, 60):
        frame = by_ticker().rowsBetween(-rows, -1)
        both = panel.select(framed_median("v", frame).alias("ours"), F.percentile("v", F.lit(0.5)).over(frame).alias("theirs"))
        assert both.filter(~F.col("ours").eqNullSafe(F.col("theirs"))).count() == 0
    liquid = _plan(tables.screened_weekly(spark, SF))
    assert "percentile(" not in liquid


def test_volatility_and_its_negative_are_one_window(spark):
    study = tables.stored_study(spark, SF)
    both = factors.with_factors(study, ["volatility", "low_vol"])
    assert _plan(both).count("var_pop(") == _plan(factors.with_factors(study, ["volatility"])).count("var_pop(")
    assert _plan(both).count("var_pop(") < _plan(study.select("*", factors.realised_vol().alias("a"), factors.low_vol().alias("b"))).count("var_pop(")
    apart = study.select("date", "ticker", factors.realised_vol().alias("volatility"), factors.low_vol().alias("low_vol"))
    assert _differ(both.select("date", "ticker", "volatility", "low_vol"), apart) == 0


def test_moments_of_volatility_are_one_window_each(spark):
    plan = factors.with_factors(tables.stored_study(spark, SF), ["volatility", "momentum"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"count\(ret#\d+\) windowspec", plan)) == len(re.findall(r"min\(date_idx#\d+\) windowspec", plan)) == 1


def test_median_column_is_the_framed_median(spark):
    value = F.when(F.col("id") % 7 != 0, F.round(F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 9), 5))
    panel = spark.range(4000).select((F.col("id") % 11).cast("string").alias("ticker"), F.col("id").alias("date"), value.alias("v"))
    for rows, least in ((1, 1), (2, 2), (60, 30)):
        frame = by_ticker().rowsBetween(-rows, -1)
        both = add_median(panel, F.collect_list("v").over(frame), "ours", least).select(
            "ours", F.when(F.count("v").over(frame) >= least, F.percentile("v", F.lit(0.5)).over(frame)).alias("theirs"))
        assert both.filter(~F.col("ours").eqNullSafe(F.col("theirs"))).count() == 0
    assert "transform(" not in _plan(tables.screened_weekly(spark, SF))  # no list of boxed numbers


def test_rank_slices_follow_the_rows(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 40).cast("double").alias("a"), F.rand(5).alias("b"))
    few = average_rank_pcts(rows, ["g"], ["a", "b"])
    monkeypatch.setattr(scratch, "PARTITION_ROWS", 500)
    many = average_rank_pcts(rows, ["g"], ["a", "b"])
    assert ", 12), REPARTITION_BY_NUM" in _plan(many) and ", 12), REPARTITION_BY_NUM" not in _plan(few)
    assert _differ(few, many) == 0
