"""Splits the price series missed, corrupt bars, and unadjusted tickers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.prices import add_median, by_ticker, row_return
from panelspark.operators.quality import bad_brackets, is_true, not_positive
from panelspark.operators.timejoin import within_days
from panelspark.schemas import PRICE_COLUMNS
from panelspark.scratch import materialise

# Gates a price step has to pass to count as a split.
SPLIT_MIN_MOVE = 0.30
KNOWN_RATIOS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)
RATIO_TOL = 0.015
MAX_VOLUME_SPIKE = 10.0
MAX_DRIFT_AFTER = 0.10
DRIFT_BARS = 3
MIN_SPLIT_PRICE = 0.50
TICK = 0.005
MIN_TICKS_MOVED = 20
CONFIRM_DAYS = 45
SMALLEST_STEP = 0.03
MIN_LOCATE_BARS = 5
UNADJUSTED_TOL = 1e-9


class RepairResult(NamedTuple):
    panel: DataFrame
    located: DataFrame | None
    fixed: DataFrame
    suspects: DataFrame
    unadjusted: DataFrame
    quarantined: DataFrame
    dropped: DataFrame


def clean_events(events: DataFrame) -> DataFrame:
    """Positive values, rounded before the distinct so one event counts once."""
    value = F.round(F.col("value").cast("double"), 8)
    return (events.filter(F.col("value") > 0)
            .select("ticker", F.col("date").cast("date").alias("recorded_date"), value.alias("value"))
            .dropDuplicates())


def _ratio(value: Column) -> Column:
    return F.when(value >= 1.0, value).otherwise(1.0 / value)


def locate_recorded_splits(panel: DataFrame, events: DataFrame, tol: float = 0.35) -> DataFrame:
    """For each recorded action, the bar within 45 days whose step fits it best."""
    # most tickers have no event: they leave before the windows
    acted = panel.join(events.select("ticker").distinct(), "ticker", "left_semi")
    bars = acted.select(
        "ticker", "date", row_return().alias("adj_ret"),
        F.count("*").over(W.partitionBy("ticker")).alias("_n"))
    bars = bars.filter((F.col("_n") >= MIN_LOCATE_BARS) & F.col("adj_ret").isNotNull())
    ratio = _ratio(F.col("value"))
    ev = clean_events(events).select(
        "ticker", "recorded_date", "value", ratio.alias("ratio"),
        F.when(F.col("value") > 1.0, -(1.0 - 1.0 / ratio)).otherwise(ratio - 1.0).alias("expected_step"))
    near = within_days(bars, ev, "ticker", "date", "recorded_date", CONFIRM_DAYS)
    gap = F.abs(F.col("adj_ret") - F.col("expected_step"))
    best = near.groupBy("ticker", "recorded_date", "value", "ratio", "expected_step").agg(
        F.min(F.struct(gap.alias("gap"), "date", "adj_ret")).alias("b"))
    needs = ((F.col("b.gap") < F.abs("expected_step") * tol) & (F.abs("expected_step") >= SMALLEST_STEP))
    return best.select("ticker", F.col("b.date").alias("date"), "recorded_date", "ratio",
                       F.col("b.adj_ret").alias("observed_step"), "expected_step",
                       needs.alias("needs_repair"))


def split_candidates(panel: DataFrame) -> DataFrame:
    """Large adjusted moves with the diagnostics that tell a split from a move."""
    prior = F.array(*[F.lag(F.col("volume").cast("double"), i).over(by_ticker()) for i in range(1, 21)])
    out = add_median(panel, F.array_compact(prior), "_usual", 5).select(
        "ticker", "date", row_return().alias("move"),
        F.try_divide(F.col("volume"), F.col("_usual")).alias("vol_x"),
        (F.try_divide(F.lead("adj_close", DRIFT_BARS).over(by_ticker()), F.col("adj_close")) - 1.0).alias("drift_after"),
        F.lag("adj_close").over(by_ticker()).alias("prev_close"))
    big = out.filter(F.abs("move") > SPLIT_MIN_MOVE)
    ratio = F.when(F.col("move") < 0, F.try_divide(F.lit(1.0), 1.0 + F.col("move"))).otherwise(1.0 + F.col("move"))
    big = big.withColumn("ratio", ratio)
    known = F.array(*[F.lit(k) for k in KNOWN_RATIOS])
    moved = F.abs(F.col("prev_close") - F.col("prev_close") / F.col("ratio"))
    return big.select(
        "*",
        is_true(F.exists(known, lambda k: F.abs(F.col("ratio") - k) / k < RATIO_TOL)).alias("ratio_ok"),
        (~is_true(F.col("vol_x") > MAX_VOLUME_SPIKE)).alias("volume_ok"),
        (~is_true(F.abs("drift_after") > MAX_DRIFT_AFTER)).alias("stable_after"),
        is_true((F.col("prev_close") >= MIN_SPLIT_PRICE) & (moved >= TICK * MIN_TICKS_MOVED)).alias("price_ok"))


def detect_splits(panel: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Candidates with ``is_split``; with a record, only confirmed steps qualify."""
    big = split_candidates(panel)
    gates = F.col("ratio_ok") & F.col("volume_ok") & F.col("stable_after") & F.col("price_ok")
    if events is None:
        return big.select("*", F.lit(False).alias("confirmed"), F.lit(None).cast("double").alias("recorded_ratio"),
                          gates.alias("is_split"))
    # a step meets the actions near it, whatever their number; its rows are joined back by what decides the match
    step = ["ticker", "date", "move", "ratio"]
    ev = clean_events(events).select("ticker", "recorded_date", "value", _ratio(F.col("value")).alias("implied"))
    fits = (F.when(F.col("value") > 1.0, F.col("move") < 0).otherwise(F.col("move") > 0)
            & (F.abs(F.col("ratio") - F.col("implied")) / F.col("implied") < RATIO_TOL))
    matched = (within_days(big.select(*step).distinct(), ev, "ticker", "date", "recorded_date", CONFIRM_DAYS).filter(fits)
               .groupBy(*step).agg(F.min(F.struct("recorded_date", "implied", "value")).alias("_m")).drop("ratio"))
    out = big.join(matched, ["ticker", "date", "move"], "left")
    confirmed = F.col("_m.implied").isNotNull()
    return out.select(*big.columns, confirmed.alias("confirmed"), F.col("_m.implied").alias("recorded_ratio"),
                      (gates & confirmed).alias("is_split"))


def apply_split_adjustment(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Rescale bars strictly before each split; several splits multiply.

    ``splits`` has ticker, date, ratio, move.  Bars and events are unioned and
    the later events' factors multiplied by one window on the ticker.
    """
    factor = F.when(F.col("move") < 0, F.col("ratio")).otherwise(1.0 / F.col("ratio"))
    ev = splits.select("ticker", "date", factor.alias("_f"))
    rest = [c for c in panel.columns if c not in ("ticker", "date")]
    both = panel.select("ticker", "date", F.struct(*rest).alias("_bar"), F.lit(1.0).alias("_f")).unionByName(
        ev.select("ticker", "date", F.lit(None).cast(panel.select(F.struct(*rest)).schema[0].dataType).alias("_bar"), "_f"))
    later = W.partitionBy("ticker").orderBy(F.unix_date("date").desc()).rangeBetween(W.unboundedPreceding, -1)
    scaled = both.withColumn("_k", F.coalesce(F.product("_f").over(later), F.lit(1.0))).filter(F.col("_bar").isNotNull())
    new = {c: F.col(f"_bar.{c}") / F.col("_k") for c in PRICE_COLUMNS if c in rest}
    if "volume" in rest:
        new["volume"] = F.col("_bar.volume").cast("double") * F.col("_k")
    return scaled.select("ticker", "date", *[new.get(c, F.col(f"_bar.{c}")).alias(c) for c in rest]).select(*panel.columns)


def find_unadjusted(panel: DataFrame, tol: float = UNADJUSTED_TOL) -> DataFrame:
    return (panel.groupBy("ticker").agg(F.max(F.abs(F.col("close") - F.col("adj_close"))).alias("max_gap"))
            .filter(F.col("max_gap") <= tol))


def find_bad_bars(panel: DataFrame) -> DataFrame:
    return panel.filter(bad_brackets() | not_positive())


def drop_bad_bars(panel: DataFrame) -> DataFrame:
    """Drop by key: a good copy of a bad bar goes with it."""
    bad = find_bad_bars(panel).select("ticker", "date").distinct()
    return panel.join(bad, ["ticker", "date"], "left_anti")


def repair(panel: DataFrame, events: DataFrame | None = None, fix_splits: bool = True,
           quarantine_unadjusted: bool = False, drop_bad: bool = True) -> RepairResult:
    """The repaired panel and everything that was changed or refused.

    With a record of corporate actions exactly those are fixed and the pattern
    detector only reports; without one, or with an empty one, the detector decides.
    """
    out = panel
    located = None
    # A record without a usable action is no record: the detector decides.  One row tells, and spares a record's panel the detector's windows.
    recorded = events is not None and not clean_events(events).isEmpty()
    if events is not None:
        located = materialise(locate_recorded_splits(out, events), "located")
    if recorded:
        fixed = located.filter("needs_repair").select("ticker", "date", "ratio", F.col("observed_step").alias("move"))
        if fix_splits:  # stored: everything below reads the adjusted panel, and none of it adjusts again
            out = materialise(apply_split_adjustment(out, fixed), "adjusted")
        suspects = detect_splits(out, events).filter(~F.col("is_split"))
    else:
        found = materialise(detect_splits(out), "candidates")
        fixed, suspects = found.filter("is_split"), found.filter(~F.col("is_split"))
        if fix_splits:
            out = materialise(apply_split_adjustment(out, fixed), "adjusted")
            if events is not None:  # what an empty record leaves in doubt is judged on the adjusted panel
                suspects = detect_splits(out).filter(~F.col("is_split"))
    unadjusted = find_unadjusted(out)
    quarantined = unadjusted if quarantine_unadjusted else unadjusted.limit(0)
    # flags on the ticker partitioning the adjustment leaves behind: no further exchange
    # and no second pass, where anti joins would read the adjusted panel again
    kept = out.select("*", F.max(F.abs(F.col("close") - F.col("adj_close"))).over(W.partitionBy("ticker")).alias("_gap"),
                      (bad_brackets() | not_positive()).alias("_bad"))
    if quarantine_unadjusted:
        kept = kept.filter(~is_true(F.col("_gap") <= UNADJUSTED_TOL))
    bad = kept.filter("_bad").drop("_gap", "_bad")
    if drop_bad:
        key_bad = F.max("_bad").over(W.partitionBy("ticker", "date"))
        kept = kept.withColumn("_key_bad", key_bad).filter(~F.col("_key_bad"))
    return RepairResult(kept.select(*panel.columns), located, fixed, suspects, unadjusted, quarantined, bad)


def repair_report(result: RepairResult) -> DataFrame:
    """Counts per outcome, including clean ratios with no action on record; each table is counted in one pass."""
    def counted(df: DataFrame, **outcomes) -> DataFrame:
        names = {k.replace("_", " "): v for k, v in outcomes.items()}
        one = df.agg(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.count_if(v) for v in names.values()])).alias("m"))
        return one.select(F.explode("m").alias("outcome", "n"))

    every = F.lit(True)
    parts = [counted(result.fixed, splits_fixed=every),
             counted(result.suspects, suspect_moves=every, near_misses=F.col("ratio_ok") & ~F.col("confirmed")),
             counted(result.unadjusted, unadjusted_tickers=every), counted(result.quarantined, quarantined_tickers=every),
             counted(result.dropped, bad_bars=every)]
    if result.located is not None:
        parts.append(counted(result.located, actions_checked=every, already_applied=~F.col("needs_repair")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
