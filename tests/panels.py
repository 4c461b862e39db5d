"""Small panels that the tests share, and the folder of the smallest tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd

SF = "/root/testdata/sf0.001"


def days(n: int, start: str = "2020-01-01") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars(spark, series: dict[str, list[float]], start: str = "2020-01-01", volume: float = 1e6, adj: float = 0.97, **extra):
    """Clean bars from closes: high and low bracket the close, adj is a fraction of it."""
    rows = [(d, t, float(c), c * 1.02, c * 0.98, float(c), c * adj, float(volume)) for t, closes in series.items()
            for d, c in zip(days(len(closes), start), closes)]
    df = spark.createDataFrame(rows, "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
                                     "adj_close DOUBLE, volume DOUBLE")
    return df


def ramp(n: int = 300, lo: float = 10.0, hi: float = 13.0) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]
