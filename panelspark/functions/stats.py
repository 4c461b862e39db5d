"""Normal-distribution helpers that Spark has no function for."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

EULER_GAMMA = 0.5772156649015329


def expected_max_normal(n: int) -> float:
    """Approximate expected maximum of n standard normals; 0 below two."""
    if n < 2:
        return 0.0
    inverse = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * inverse(1 - 1 / n) + EULER_GAMMA * inverse(1 - 1 / (n * math.e))


def expected_max_sharpe(n_trials: int, variance: Column) -> Column:
    """Sharpe to expect from the best of n worthless strategies."""
    return F.sqrt(variance) * F.lit(expected_max_normal(n_trials))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function at double precision, null for null.

    Up to 5 in size the series of odd powers over double factorials, each term from the one before; beyond, the
    continued fraction of the tail.
    """
    size = F.abs(z)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    first = F.struct(z.cast("double").alias("term"), z.cast("double").alias("total"))

    def grow(acc, k):
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), first, grow, lambda acc: F.lit(0.5) + density * acc["total"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), size.cast("double"), lambda acc, k: size + k / acc)
    tail = density / fraction
    return F.when(size <= 5, series).when(z < 0, tail).otherwise(1 - tail)


def required_vol(gap: Column, confidence: float = 0.33) -> Column:
    """Volatility that closes a gap with the given probability; 0 when already ahead."""
    z = NormalDist().inv_cdf(1.0 - confidence)
    reach = gap / F.lit(z) if z > 0 else F.lit(float("inf"))
    return F.when(gap <= 0, 0.0).otherwise(reach)
