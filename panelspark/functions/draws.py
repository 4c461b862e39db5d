"""Reproducible draws: a hash of keys, never a generator, so results do not
depend on partitioning, retries or lost executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash48(*keys: Column) -> Column:
    """A 48-bit non-negative integer from the keys."""
    joined = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("bigint")


def unit_draw(*keys: Column) -> Column:
    """A number in [0, 1)."""
    return hash48(*keys) / F.lit(float(1 << 48))


def sample_positions(n: Column, size: int | Column, *keys: Column) -> Column:
    """min(n, size) distinct positions from 1..n, each subset equally likely.

    Floyd's sampling: for j in n-size+1..n draw t from 1..j and keep t, or j
    itself when t is already taken.  Exact, with one draw per position.
    """
    take = F.least(n, size if isinstance(size, Column) else F.lit(size)).cast("bigint")
    steps = F.when(take > 0, F.sequence(n.cast("bigint") - take + 1, n.cast("bigint")))

    def add(acc: Column, j: Column) -> Column:
        t = F.pmod(hash48(*keys, j), j) + 1
        return F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), add)
