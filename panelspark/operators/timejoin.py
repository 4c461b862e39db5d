"""Joins on time: rows within days of each other, and the last row at or before a time.

Neither gathers a key's rows: a key that holds a third of a table is split by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.scratch import materialise


def within_days(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, days: int, after: int | None = None) -> DataFrame:
    """Pairs of rows of one key: the left date lies at most ``days`` before the right one, or ``after`` (else also ``days``) after it.

    The columns of both sides have different names.  Time is cut into bins as long as a right row's reach.  A left row lies in one
    bin, and the reach of a right row in at most two, to which it is
    copied; so this is an equi-join on (key, bin) with an exact filter, each pair is found once, and a key with very many rows is as many
    groups as there are bins in its history.  A null key or date pairs with nothing.
    """
    after = days if after is None else after
    width = days + after + 1

    def bin_of(date: Column) -> Column:
        return F.floor(F.unix_date(date) / width)

    reach = F.array_distinct(F.array(bin_of(F.date_sub(right_on, days)), bin_of(F.date_add(right_on, after))))
    near = right.withColumn("_bin", F.explode(reach))
    mine = left.withColumn("_bin", bin_of(F.col(left_on)))
    return (mine.join(near, [key, "_bin"]).filter(F.date_diff(left_on, right_on).between(-days, after))
            .select(*left.columns, *[c for c in right.columns if c != key]))


def asof(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Left rows with ``values`` of the last right row of their key at or before their time (``strict``: before it).

    Both sides are unioned and range partitioned by (key, time), so a hot key is many slices.  Within a slice the last right row is carried
    over by a window; what a slice hands on to the next is one row for each of its keys, carried over slices in a second pass.  Of right rows
    of one time the greatest by ``values`` counts.  A null key or time finds nothing.
    """
    spark = left.sparkSession
    found = right.filter(F.col(key).isNotNull() & F.col(right_on).isNotNull())
    both = (left.select(F.col(key).alias("_key"), F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"))
            .unionByName(found.select(F.col(key).alias("_key"), F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
                                      F.struct(*values).alias("_right")), allowMissingColumns=True))
    order = ["_t", "_side", "_right", "_spread"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the spread lets left rows of one key and time lie in different slices
    ranged = (both.withColumn("_spread", F.when(F.col("_left").isNotNull(), F.xxhash64("_left")))
              .repartitionByRange(parts, "_key", *order).withColumn("_slice", F.spark_partition_id()))
    ranged = materialise(ranged, "asof")
    ends = (ranged.filter(F.col("_right").isNotNull()).groupBy("_key", "_slice")
            .agg(F.max_by("_right", F.struct("_t", "_right")).alias("_end")))
    slices = ranged.filter(F.col("_left").isNotNull()).select("_key", "_slice").distinct()
    before = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    handed = (slices.join(ends, ["_key", "_slice"], "full")
              .select("_key", "_slice", F.last("_end", ignorenulls=True).over(before).alias("_handed")).filter(F.col("_handed").isNotNull()))
    so_far = W.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("_own", F.last("_right", ignorenulls=True).over(so_far)).filter(F.col("_left").isNotNull())
    known = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_handed"))
    out = placed.join(handed, ["_key", "_slice"], "left").withColumn("_found", known)
    return out.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])
