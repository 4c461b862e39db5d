"""Exact ordered positions, ranks and quantiles within groups of any size.

A date's cross-section, or one decile of all history, can hold a large share of
all rows, so ``row_number() over (partition by date ...)`` would put it in one
task.  There is one path for groups of every size: rows are range-partitioned by
(group, order) across the cluster, written to the checkpoint folder so that both
passes see the same split, and every slice adds the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.scratch import materialise, partitions_for_rows


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                weight: Column, before: str, total: str | None = None) -> DataFrame:
    """Add ``before``: sum of weight over the rows ordered earlier in the group.

    ``order`` has to be unique within the group.  ``total`` names the group sum.
    """
    group = list(group)
    keys = [F.col(g) for g in group]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.withColumn("_w", weight).repartitionByRange(parts, *keys, *order)
              .withColumn("_slice", F.spark_partition_id()))
    ranged = materialise(ranged, "ordered")
    slices = ranged.groupBy(*group, "_slice").agg(F.sum("_w").alias("_sw"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        *group, "_slice",
        F.coalesce(F.sum("_sw").over(earlier), F.lit(0).cast("bigint")).alias("_base"),
        F.sum("_sw").over(W.partitionBy(*keys)).alias("_total"))
    local = (W.partitionBy(*keys, "_slice").orderBy(*order)
             .rowsBetween(W.unboundedPreceding, -1))
    placed = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(local), F.lit(0).cast("bigint")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_slice"]]
    out = placed.alias("r").join(slices.alias("s"), same)
    added = [(F.col("_base") + F.col("_local")).alias(before)] + [F.col("_total").alias(total)] * bool(total)
    return out.select(*[F.col(f"r.{c}") for c in df.columns], *added)


def ordinal(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
            position: str, total: str | None = None) -> DataFrame:
    """1-based row number within the group, in a unique order."""
    out = running_sum(df, group, order, F.lit(1).cast("bigint"), "_before", total)
    return out.withColumn(position, F.col("_before") + 1).drop("_before")


def average_rank_pcts(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Percentile ranks 0-100 of several columns, ties sharing their average rank.

    Adds pct_<value> (null for a null value) and n_<value>, the non-null count.

    All columns are ordered in one range pass that carries the rows (or their numbers), so nothing is joined on a value, and rows of one value may lie in
    several slices: within a slice a window counts smaller and equal rows, and only the first and last value of a slice can go on in its
    neighbours.  Those, two a slice and group, are settled in a second pass over slices.  The number of slices follows the rows.
    """
    group, values = list(group), list(values)
    stored = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    parts = partitions_for_rows(df.sparkSession, stored.count() * len(values))  # counted from the files' footers
    # one row for each column to rank; one column alone carries the whole row, several carry its number
    carried = [F.struct(*df.columns).alias("_all")] if len(values) == 1 else []
    copies = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(v).cast("double").alias("_v"), *carried) for i, v in enumerate(values)])
    key = [*group, "_which"]
    ranged = (stored.select(*group, "_row", F.explode(copies).alias("_x")).select(*group, "_row", "_x.*")
              .repartitionByRange(parts, *key, "_v", "_row").withColumn("_slice", F.spark_partition_id()).repartition(parts, *key, "_slice"))
    own = W.partitionBy(*key, "_slice")
    placed = materialise(ranged.withColumns({"_under": F.rank().over(own.orderBy(F.col("_v").asc_nulls_last())) - 1,
                                             "_same": F.count("*").over(W.partitionBy(*key, "_slice", "_v"))}), "placed")

    # slices of a group: how many values each holds, and its first and last value with their counts
    slices = placed.filter(F.col("_v").isNotNull()).groupBy(*key, "_slice").agg(
        F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.count("*").alias("_size"),
        F.min_by("_same", "_v").alias("_n_first"), F.max_by("_same", "_v").alias("_n_last"))
    before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = materialise(slices.withColumns({"_base": F.coalesce(F.sum("_size").over(before), F.lit(0)),
                                             "_n": F.sum("_size").over(W.partitionBy(*key))}), "slices")
    last_below = F.col("_base") + F.when(F.col("_first") == F.col("_last"), 0).otherwise(F.col("_size") - F.col("_n_last"))
    edges = slices.select(*key, F.inline(F.array_distinct(F.array(
        F.struct(F.col("_first").alias("_v"), F.col("_n_first").alias("_ties"), F.col("_base").alias("_below")),
        F.struct(F.col("_last").alias("_v"), F.col("_n_last").alias("_ties"), last_below.alias("_below"))))))
    edges = edges.groupBy(*key, "_v").agg(F.sum("_ties").alias("_ties"), F.min("_below").alias("_below"))

    def edge(name: str) -> DataFrame:
        return edges.select(*key, F.col("_v").alias(name), F.struct("_ties", "_below").alias(f"{name}_is"))

    totals = slices.groupBy(*key).agg(F.max("_n").alias("_n"))  # one row for each group and column
    slices = slices.drop("_n").join(edge("_first"), [*key, "_first"]).join(edge("_last"), [*key, "_last"])
    out = (placed.join(slices.select(*key, "_slice", "_first", "_last", "_first_is", "_last_is", "_base"), [*key, "_slice"], "left")
           .join(totals, key, "left"))
    settled = (F.when(F.col("_v") == F.col("_first"), F.col("_first_is")).when(F.col("_v") == F.col("_last"), F.col("_last_is"))
               .otherwise(F.struct(F.col("_same").alias("_ties"), (F.col("_base") + F.col("_under")).alias("_below"))))
    out = out.withColumn("_is", settled)
    pct = F.when(F.col("_v").isNotNull(), (F.col("_is._below") + (F.col("_is._ties") + 1) / 2) / F.col("_n") * 100)
    out = out.withColumns({"_pct": pct, "_n": F.coalesce("_n", F.lit(0).cast("bigint"))})
    if len(values) == 1:
        return out.select("_all.*", F.col("_pct").alias(f"pct_{values[0]}"), F.col("_n").alias(f"n_{values[0]}"))
    picked = [F.max(F.when(F.col("_which") == i, F.col(c))).alias(f"{name}_{v}") for i, v in enumerate(values) for c, name in (("_pct", "pct"), ("_n", "n"))]
    # both sides are dealt by row number into as many parts, so that the sorts of a task follow no table and nothing is dealt twice
    wide = out.repartition(parts, "_row").groupBy("_row").agg(*picked)
    return stored.repartition(parts, "_row").join(wide, "_row").select(*df.columns, *[f"{name}_{v}" for v in values for name in ("pct", "n")])


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, interpolated as ``percentile`` does, one column per name."""
    group = list(group)
    counts = (df.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
              .groupBy(*group, "_v").agg(F.count("*").alias("_n")))
    placed = running_sum(counts, group, [F.col("_v")], F.col("_n"), "_below", "_all")

    def at(position: Column) -> Column:
        inside = (F.col("_below") <= position) & (position < F.col("_below") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v").cast("double")))

    picks = []
    for i, p in enumerate(quantiles.values()):
        place = (F.col("_all") - 1) * F.lit(p)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place).alias(f"_at{i}")]
    found = placed.groupBy(*group).agg(*picks)

    def between(i: int) -> Column:
        lo, hi, place = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_at{i}")
        mixed = (F.ceil(place) - place) * lo + (place - F.floor(place)) * hi
        return F.when((F.ceil(place) == F.floor(place)) | (lo == hi), lo).otherwise(mixed)

    return found.select(*group, *[between(i).alias(n) for i, n in enumerate(quantiles)])
