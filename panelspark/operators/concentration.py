"""How concentrated portfolios picked by simple rules fare over real windows, and today's ranking by the same rules.

Scores use bars strictly before the start date, returns run from the start date,
and eligibility on the start date gates what may be bought.  Random scores and the
order of ties are hashes of their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.costs import BOARD_LOT, affordable_lots, round_trip_pct
from panelspark.functions.draws import unit_draw
from panelspark.functions.prices import at_calendar_offset, change
from panelspark.scratch import materialise
from panelspark.schemas import ZERO_COMMISSION, Broker

# The rules' names.
RULES = ("random", "high_vol", "low_vol", "momentum", "reversal")
# Fixed value: with fewer dates of history than this, names are scored at random.
MIN_HISTORY = 10


def window_return(horizon: int, price: str = "adj_close") -> Column:
    """Return from this calendar date to ``horizon`` dates later."""
    return change(at_calendar_offset(price, horizon), F.col(price))


def prior_momentum(lookback: int, shift: int = 0, price: str = "adj_close") -> Column:
    """First to last of the ``lookback`` dates before this one (or up to it, with shift 1)."""
    return change(at_calendar_offset(price, -1 + shift), at_calendar_offset(price, -lookback + shift))


def prior_vol(lookback: int, shift: int = 0) -> Column:
    """Deviation of the calendar returns inside the ``lookback`` dates before this one.

    The window restarts the series: its first bar has no return, and dates
    without a bar after it count as zero.  Sums over the bars present give this
    without a dense grid.
    """
    w = W.partitionBy("ticker").orderBy("date_idx").rangeBetween(-lookback + shift, -1 + shift)
    opening = F.coalesce(F.first("ret").over(w), F.lit(0.0))
    n = F.col("date_idx") - 1 + shift - F.min("date_idx").over(w)
    total = F.sum(F.coalesce("ret", F.lit(0.0))).over(w) - opening
    squares = F.sum(F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))).over(w) - opening * opening
    return F.when(n >= 2, F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1)))


def window_rows_table(study: DataFrame, horizon: int, lookback: int) -> DataFrame:
    """Eligible starts with a forward return and both score ingredients."""
    wide = study.select(
        "date", "date_idx", "ticker", "eligible", window_return(horizon).alias("fwd"),
        prior_momentum(lookback).alias("mom"), prior_vol(lookback).alias("vol"))
    return wide.filter(F.col("eligible") & F.col("fwd").isNotNull()).drop("eligible")


def spans_all(study: DataFrame) -> DataFrame:
    return study.agg(F.min("date_idx").alias("first_idx"), (F.max("date_idx") + 1).alias("end_idx")).select(
        F.lit("all").alias("span"), "first_idx", "end_idx")


def start_range(spans: DataFrame, horizon: int, lookback: int) -> DataFrame:
    """Starts lie lookback+1 dates into the span and horizon+1 before its end."""
    return spans.select("span", (F.col("first_idx") + lookback + 1).alias("lo"),
                        (F.col("end_idx") - horizon - 1).alias("hi")).filter(F.col("hi") > F.col("lo"))


def candidates(windows: DataFrame, starts: DataFrame, min_names: int) -> DataFrame:
    """Names on offer per start, where there are enough of them."""
    # a row per start date, stored so that Spark sees it is small
    days = materialise(starts.select("span", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("date_idx")), "starts")
    inside = windows.join(days, "date_idx")
    enough = inside.groupBy("span", "date_idx").agg(F.count("*").alias("n")).filter(F.col("n") >= min_names)
    return inside.join(enough.select("span", "date_idx"), ["span", "date_idx"], "left_semi")


def rule_score(rule: Column, seed: int, history: Column) -> Column:
    """A name's score; ``history``: dates before the start that the rule may look at."""
    return (F.when(history < MIN_HISTORY, unit_draw(F.lit(seed), F.col("date"), F.col("ticker"))).when(rule == "momentum", F.col("mom")).when(rule == "reversal", -F.col("mom"))
            .when(rule == "high_vol", F.col("vol")).when(rule == "low_vol", -F.col("vol"))
            .otherwise(unit_draw(F.lit(seed), F.col("date"), F.col("ticker"))))


def rule_scores(names: DataFrame, rules=RULES, seed: int = 0, lookback: int = 60) -> DataFrame:
    """One row per start, name and rule with a usable score."""
    history = F.least(F.lit(lookback), F.col("date_idx"))
    ruled = names.select("*", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    return ruled.withColumn("score", rule_score(F.col("rule"), seed, history)).filter(F.col("score").isNotNull())


def top_k_portfolios(scores: DataFrame, ks: tuple[int, ...], seed: int = 0) -> DataFrame:
    """Equal-weight forward return of the best k names per start and rule; equal scores go in the order of a draw."""
    tie = unit_draw(F.lit(seed), F.lit("tie"), F.col("rule"), F.col("date"), F.col("ticker"))
    order = W.partitionBy("span", "date_idx", "rule").orderBy(F.col("score").desc(), tie, "ticker")
    best = scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(ks))
    sized = best.select("span", "date", "date_idx", "rule", "place", "fwd", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return (sized.filter(F.col("place") <= F.col("k")).groupBy("span", "date", "date_idx", "rule", "k")
            .agg(F.round(F.avg("fwd"), 10).alias("portfolio_return")))


def leaderboard(portfolios: DataFrame, start: tuple[str, ...] = ("span", "date_idx")) -> DataFrame:
    """Rank of every portfolio at its start; ties share the win."""
    by = [F.col(c) for c in start]
    place = F.rank().over(W.partitionBy(*by).orderBy(F.col("portfolio_return").desc()))
    tied = F.count("*").over(W.partitionBy(*by, "portfolio_return")) - 1
    ranked = portfolios.select("*", (place - 1).alias("beaten_by"), tied.alias("tied"))
    return ranked.select("*", F.when(F.col("beaten_by") == 0, 1.0 / (F.col("tied") + 1)).otherwise(0.0).alias("win_credit"),
                         (F.col("beaten_by") < 3).alias("top3"))


def rank_universe(study: DataFrame, as_of: DataFrame, rule: str = "momentum", lookback: int = 60, seed: int = 0) -> DataFrame:
    """Live ranking on the ``as_of`` date: history includes it, eligibility gates only what is buyable."""
    scored = study.select("*", prior_momentum(lookback, 1).alias("mom"), prior_vol(lookback, 1).alias("vol"))
    today = scored.filter((F.col("date") == as_of.select("as_of").scalar()) & F.col("eligible"))
    history = F.least(F.lit(lookback), F.col("date_idx") + 1)
    return today.withColumn("score", rule_score(F.lit(rule), seed, history)).filter(F.col("score").isNotNull())


def enrich(ranked: DataFrame, capital: float, broker: Broker = ZERO_COMMISSION) -> DataFrame:
    """Lots, cash and round-trip cost per ranked name; names the account cannot buy are dropped."""
    lots = affordable_lots(F.col("close"), capital)
    out = ranked.select("ticker", "score", F.col("close").alias("price"), lots.alias("lots"),
                        (lots * BOARD_LOT).alias("shares"), (lots * BOARD_LOT * F.col("close")).alias("notional"), "median_dtv")
    return (out.filter(F.col("lots") > 0).withColumn("cash_left", F.lit(float(capital)) - F.col("notional"))
            .withColumn("roundtrip_pct", round_trip_pct(F.col("notional"), broker.rate_pct, broker.min_fee, broker.sst)))


def pick(enriched: DataFrame, k: int = 1, runners_up: int = 10) -> DataFrame:
    """The top k and the names next in line."""
    top = enriched.orderBy(F.col("score").desc(), "ticker").limit(k + runners_up)
    place = F.row_number().over(W.orderBy(F.col("score").desc(), "ticker"))  # k + runners_up rows
    return top.withColumn("place", place).withColumn("role", F.when(F.col("place") <= k, "pick").otherwise("runner-up"))

