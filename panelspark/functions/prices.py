"""Per-ticker bar expressions.  A ticker has at most one bar per date, so its
window is bounded by the length of the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

def by_ticker():
    return W.partitionBy("ticker").orderBy("date")


def change(new: Column, old: Column) -> Column:
    """new/old - 1, null instead of an infinity."""
    return F.try_divide(new, old) - 1.0


def row_return(price: str = "adj_close") -> Column:
    """Return over the ticker's own previous bar."""
    return change(F.col(price), F.lag(price).over(by_ticker()))


def add_returns(panel: DataFrame, price: str = "adj_close") -> DataFrame:
    return panel.withColumn("ret", row_return(price))


def framed_median(value: str, frame: WindowSpec) -> Column:
    """Median of a frame of few rows, with the bits of ``percentile``, null when it has no value.

    The values are listed and sorted, where ``percentile`` would build a hash table of boxed numbers for every row.
    """
    held = F.sort_array(F.collect_list(F.col(value).cast("double")).over(frame))

    def middle(v: Column) -> Column:
        low, high = F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")), F.get(v, F.floor(F.size(v) / 2).cast("int"))
        return F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)

    return F.transform(F.array(held), middle)[0]  # the one-element array binds the list, so it is sorted once


def add_median(df: DataFrame, values: Column, name: str, least: int = 1) -> DataFrame:
    """Add the median of a list of doubles without nulls, with the bits of ``percentile``; null for fewer than ``least`` values.

    The sorted list is a column of its own for a moment: generated code then sorts plain doubles, once a row, where a
    function over the list would sort boxed ones, and its size is the count.
    """
    low, high = F.get("_held", F.floor((F.size("_held") - 1) / 2).cast("int")), F.get("_held", F.floor(F.size("_held") / 2).cast("int"))
    median = F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)
    return (df.withColumn("_held", F.sort_array(values)).withColumn(name, F.when(F.size("_held") >= least, median))
            .drop("_held"))


def at_calendar_offset(value: str, offset: int) -> Column:
    """The ticker's value exactly ``offset`` calendar dates away; null when it has no bar there."""
    exact = W.partitionBy("ticker").orderBy("date_idx").rangeBetween(offset, offset)
    return F.max(value).over(exact)
