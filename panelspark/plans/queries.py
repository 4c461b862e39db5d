"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelspark.functions import costs, prices, symbols
from panelspark.operators import (backtest, baselines, baserates, calendar as cal_ops, concentration, factors, metrics,
                                  ordering, positions, quality, reconcile, repair, timejoin, universe, walkforward)
from panelspark.operators.literals import rows, setting_rows
from panelspark.scratch import materialise, scratch_path
from panelspark.schemas import BANK_LOW, BROKERS, BacktestConfig, WindowConfig
from panelspark.sources import ingest, listtext, payload, sinks, tables
from panelspark.streaming import bars as stream_bars, quotes as stream_quotes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TRADING = BacktestConfig(capital=10_000.0, rebalance="ME", broker=BANK_LOW, max_positions=5)
WINDOW = WindowConfig(horizon=13, lookback=26, min_names=10, seed=41)
SHORT_LOOKBACK = 8  # too short for any rule
N_RANDOM, N_NAMES = 200, 3
WF = {"n_folds": 5, "train_months": 24, "test_months": 6, "holdout_months": 12}
GAP_DAYS, MIN_BARS = tables.WEEKLY_GAP_DAYS, 290


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def q6(c: Column) -> Column:
    """Half-up to six decimals by the same arithmetic as the oracle."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: q6(F.col(n)) for n in names})


def logged(df: DataFrame, **columns: str) -> DataFrame:
    """Growth as logarithms: derived prices are noise, and compounding them overflows six decimals."""
    for old, new in columns.items():
        df = df.withColumn(old, F.when(F.col(old) > -1, F.log(1 + F.col(old)))).withColumnRenamed(old, new)
    return df


def study(spark: SparkSession, sf: str) -> DataFrame:
    return tables.stored_study(spark, sf)


# ---- scans, ingest, sinks

@query
def weekly_bars(spark, sf):
    return tables.weekly_bars(spark, sf)


@query
def upsert_fresh_wins(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    fresh = bars.filter(F.col("volume") >= 20).withColumn("close", F.col("close") + 1)
    return ingest.upsert_fresh_wins(bars, fresh)


@query
def normalised_bars(spark, sf):
    raw = tables.weekly_bars(spark, sf)
    vendor = raw.select(
        F.col("date").cast("string").alias("Date"), F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"),
        *[F.when(F.col("volume") == 7, F.lit("n/a")).otherwise(F.col(c).cast("string")).alias(c.capitalize())
          for c in ("open", "high", "low", "close")], F.col("volume").cast("string").alias("Volume"))
    return ingest.normalise(vendor.unionByName(vendor.withColumn("Volume", F.lit("99999"))))


def _payloads(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    landed = bars.withColumns({"close": F.when(F.col("volume") == 7, None).otherwise(F.col("close")),
                               "volume": F.when(F.col("volume") == 11, None).otherwise(F.col("volume"))})
    return payload.to_payloads(landed, tables.corporate_events(spark, sf, bars))


@query
def json_bars(spark, sf):
    return payload.payload_bars(_payloads(spark, sf))


@query
def json_events(spark, sf):
    return payload.payload_events(_payloads(spark, sf), "splits")


@query
def merged_events(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    ev = tables.corporate_events(spark, sf, bars)
    noisy = ev.withColumn("value", F.col("value") + 1e-10)
    return ingest.merge_events(ev, noisy)


@query
def text_codes(spark, sf):
    lines = tables.list_lines(spark, sf)
    return listtext.list_codes(listtext.list_section(lines)).select("doc_id", "code", "n_codes", "plausible")


@query
def text_sections(spark, sf):
    """Text between the first and the next marker line of every document."""
    docs = tables.table(spark, sf, "documents")
    section = listtext.document_section(docs, start=r"(?i)\bthe\b", end=r"(?i)\bwith\b.*\bby\b")
    return section.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"),
                                         F.sum(F.length("line")).alias("n_chars"))


@query
def candidate_codes(spark, sf):
    return ingest.candidate_codes(tables.table(spark, sf, "supplier").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("code")))


@query
def fetch_worklist(spark, sf):
    listed = tables.table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"))
    cached = (tables.table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 45)
              .select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker")))
    return ingest.fetch_worklist(listed, cached)


@query
def load_summary(spark, sf):
    wanted = tables.membership(spark, sf).select("ticker").unionByName(rows(spark, "ticker STRING", [("UNKNOWN",)]))
    return ingest.load_summary(wanted, tables.weekly_bars(spark, sf))


@query
def coverage_profile(spark, sf):
    return rounded(ingest.coverage_profile(tables.weekly_bars(spark, sf), 90, 500.0), "median_recent_dtv")


@query
def coverage_summary(spark, sf):
    return ingest.coverage_summary(ingest.coverage_profile(tables.weekly_bars(spark, sf), 90, 500.0))


@query
def raw_glob_bars(spark, sf):
    """Files of three vendors under one glob: other spellings, no adjusted close, a column more."""
    path = scratch_path(spark, "raw")
    bars = tables.weekly_bars(spark, sf).withColumn("_n", F.substring("ticker", 2, 12).cast("bigint") % 3)
    bars.filter("_n = 0").select(F.col("date").alias("Date"), "ticker", *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")]
                                 ).write.parquet(f"{path}/a")
    bars.filter("_n = 1").drop("_n").withColumnRenamed("adj_close", "Adj Close").write.parquet(f"{path}/b")
    bars.filter("_n = 2").drop("_n").withColumn("source", F.lit("c")).write.parquet(f"{path}/c")
    raw = ingest.load_raw(spark, f"{path}/*")
    return ingest.normalise(raw.withColumn("adj_close", F.coalesce("adj_close", "close")))


def _coded(listed: DataFrame) -> DataFrame:
    """Codes with leading zeros; every seventh line has a date that doesn't read."""
    code = F.lpad(F.substring("ticker", 2, 12).cast("bigint").cast("string"), 5, "0")
    date = F.when(F.substring("ticker", 2, 12).cast("bigint") % 7 == 0, "n/a").otherwise(F.col("list_date").cast("string"))
    return listed.select(date.alias("list_date"), code.alias("ticker"))


@query
def membership_csv(spark, sf):
    path = scratch_path(spark, "membership-csv")
    _coded(tables.membership(spark, sf)).write.option("header", True).csv(path)
    lines = ingest.read_csv(spark, path, "list_date DATE, ticker STRING")
    return lines.select("list_date", "ticker", F.col("bad_record").isNotNull().alias("bad"))


@query
def membership_loaded(spark, sf):
    path = scratch_path(spark, "membership-csv")
    _coded(tables.membership(spark, sf)).write.option("header", True).csv(path)
    return ingest.load_membership(spark, path, skip_undated=True)


@query
def split_csv_scan(spark, sf):
    path = scratch_path(spark, "split-csv")
    found = tables.corporate_events(spark, sf, tables.weekly_bars(spark, sf))
    value = F.when(F.substring("ticker", 2, 12).cast("bigint") % 5 == 0, "two for one").otherwise(F.col("value").cast("string"))
    found.select("date", "ticker", value.alias("value")).write.option("header", True).csv(path)
    return ingest.events_profile(ingest.load_events(spark, path))


@query
def landed_panel(spark, sf):
    return payload.landed_panel(_payloads(spark, sf))


@query
def verified_codes(spark, sf):
    path = scratch_path(spark, "verified")
    bars = tables.weekly_bars(spark, sf)
    asked = tables.membership(spark, sf).select("ticker").distinct().unionByName(rows(spark, "ticker STRING", [("UNKNOWN",)]))
    sinks.write_verified(ingest.load_summary(asked, bars.filter("volume >= 45")), path)
    return spark.read.schema("code STRING").option("header", True).csv(path)


@query
def snapshot_replaced(spark, sf):
    """A release written a second time with fewer names: it is replaced, and the others stay."""
    path = scratch_path(spark, "releases")
    lists = tables.membership(spark, sf)
    sinks.replace_snapshot(lists, path)
    fewer = lists.filter((F.col("list_date") == F.lit(tables.RELEASES[1][0]).cast("date")) & (F.substring("ticker", 2, 12).cast("bigint") % 2 == 0))
    sinks.replace_snapshot(fewer, path)
    return spark.read.schema("list_date DATE, ticker STRING").parquet(path)


@query
def decision_journal(spark, sf):
    """Decisions of two dates, one of them written again by a retry."""
    path = scratch_path(spark, "journal")
    bars = tables.weekly_bars(spark, sf)
    for decision, date in (("1997-03-03", "1997-03-03"), ("1999-06-07", "1999-06-07"), ("1997-03-03", "1997-03-03")):
        picks = bars.filter(F.col("date") == F.lit(date).cast("date")).select(
            "ticker", F.col("close").alias("price"), F.col("volume").cast("bigint").alias("lots"),
            (F.col("close") * F.col("volume")).alias("notional"), F.col("volume").alias("score"))
        sinks.record_decision(picks, path, decision, "volume", 10_000.0)
    return rounded(sinks.read_journal(spark, path).drop("decided_at"), "price", "notional")


@query
def events_within_days(spark, sf):
    """Weekly moves of more than a third, with the trades of their ticker within ten days."""
    moved = prices.add_returns(tables.weekly_bars(spark, sf)).filter(F.abs("ret") > 1 / 3).select(*KEY)
    trades = tables.line_ticks(tables.table(spark, sf, "lineitem")).select(
        tables.ticker_of(F.col("l_suppkey")).alias("ticker"), F.col("ts").cast("date").alias("traded_on"), "quantity")
    near = timejoin.within_days(moved, trades, "ticker", "date", "traded_on", 10)
    return near.groupBy(*KEY).agg(F.count("*").alias("n_trades"), F.sum("quantity").alias("quantity"),
                                  F.min(F.abs(F.date_diff("date", "traded_on"))).alias("nearest_days"))


@query
def quotes_asof(spark, sf):
    """Every trade with the last weekly bar that was complete on its day."""
    trades = tables.line_ticks(tables.table(spark, sf, "lineitem")).select(
        tables.ticker_of(F.col("l_suppkey")).alias("ticker"), F.col("ts").cast("date").alias("traded_on"), "price", F.col("seq.l_orderkey").alias("l_orderkey"))
    bars = tables.weekly_bars(spark, sf).select("ticker", F.date_add("date", 7).alias("known_on"), F.col("date").alias("bar_date"), F.col("close").alias("prior_close"))
    return rounded(timejoin.asof(trades, bars, "ticker", "traded_on", "known_on", ["bar_date", "prior_close"]), "price", "prior_close")


@query
def symbol_forms(spark, sf):
    code = F.lower(tables.ticker_of(F.col("s_suppkey")))
    s = tables.table(spark, sf, "supplier").select(code.alias("code"))
    return s.select("code", symbols.to_symbol(F.col("code")).alias("symbol"),
                    symbols.bare_code(symbols.to_symbol(F.col("code"))).alias("bare"),
                    symbols.to_prefixed(symbols.to_symbol(F.col("code"))).alias("prefixed"))


@query
def streamed_bars(spark, sf):
    """Order lines read as a stream, rolled into bars and upserted."""
    return stream_bars.run_bars_stream(spark, sf)


@query
def streamed_bars_late(spark, sf):
    """Replayed in order of time: bars that no trade within two weeks can change are closed, and their state is freed."""
    return stream_bars.run_bars_replay(spark, sf, late="14 days")


@query
def panel_written_by_year(spark, sf):
    path = scratch_path(spark, "panel-by-year")
    sinks.write_panel(tables.weekly_bars(spark, sf), path, by_year=True)
    return ingest.load_panel(spark, path)


@query
def panel_span(spark, sf):
    return quality.panel_span(tables.weekly_bars(spark, sf))


@query
def streamed_bad_bars(spark, sf):
    return stream_bars.run_checks_stream(spark, sf).groupBy("violation").agg(F.count("*").alias("n_rows"))


@query
def streamed_stale(spark, sf):
    """Tickers without a good quote for two days, each time it happens."""
    return rounded(stream_quotes.run_stale_stream(spark, sf, "2 days", "1 hour"), "last_price")


@query
def streamed_quotes(spark, sf):
    return stream_quotes.run_quotes_stream(spark, sf).select("ticker", "event_id", "price", "quoted_at")


# ---- projections and scalars

@query
def bar_returns(spark, sf):
    return rounded(prices.add_returns(tables.weekly_bars(spark, sf)).select("date", "ticker", "ret"), "ret")


@query
def trade_costs(spark, sf):
    orders = tables.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    brokers = setting_rows("broker STRING, rate_pct DOUBLE, min_fee DOUBLE, sst DOUBLE",
                           [(b.name, b.rate_pct, b.min_fee, b.sst) for b in BROKERS])
    v, fee = F.col("value"), (F.col("rate_pct"), F.col("min_fee"), F.col("sst"))
    out = orders.select("*", F.inline(brokers)).select(
        "o_orderkey", "broker", costs.brokerage(v, *fee).alias("brokerage"), costs.stamp_duty(v).alias("stamp_duty"),
        costs.clearing_fee(v).alias("clearing_fee"), costs.slippage(v).alias("slippage"),
        costs.total_cost(v, *fee).alias("total"), costs.round_trip_pct(v, *fee).alias("round_trip_pct"))
    return rounded(out, "brokerage", "clearing_fee", "slippage", "total", "round_trip_pct")


@query
def affordable_lots(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    return bars.select("date", "ticker", costs.affordable_lots(F.col("close"), 10_000.0).alias("lots"),
                       costs.affordable_breadth(F.col("volume") * 100, 8.0).cast("bigint").alias("breadth"))


@query
def affordable_names(spark, sf):
    """Names an account can hold at the median close of each date."""
    bars = tables.weekly_bars(spark, sf)
    mid = ordering.exact_quantiles(bars, ["date"], "close", {"median_close": 0.5})
    return rounded(mid.withColumn("max_names", costs.max_affordable_names(F.col("median_close"), 10_000.0)), "median_close")


@query
def market_sessions(spark, sf):
    quotes = tables.event_quotes(spark, sf)
    now = F.col("quoted_at") + F.expr("INTERVAL 50 MINUTES")
    return rounded(positions.quote_status(quotes, now).select(
        "event_id", "market", "session_start", "age_minutes", "staleness"), "age_minutes")


def _quotes(spark, sf):
    q = tables.event_quotes(spark, sf)
    first = q.groupBy("ticker").agg(F.min_by("volume", F.struct("quoted_at", "event_id")).alias("prev_close"),
                                    F.count("*").alias("n"))
    return positions.latest_quotes(q, ("quoted_at", "event_id")), first


@query
def latest_quote(spark, sf):
    return _quotes(spark, sf)[0].select("ticker", "event_id", "price", "quoted_at", "error")


@query
def position_standing(spark, sf):
    last, first = _quotes(spark, sf)
    held = first.select("ticker", F.col("n").alias("shares"), F.col("prev_close").alias("entry_price"))
    quoted = last.join(first.select("ticker", "prev_close"), "ticker")
    return rounded(positions.standing(held, quoted, F.lit(10_000.0)), "change_pct", "position_value", "pnl_pct", "equity",
                   "return_pct", "gap_pct")


@query
def position_verdicts(spark, sf):
    e = tables.table(spark, sf, "events")
    s = e.select("event_id", F.date_diff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")).alias("days_left"),
                 (F.col("value") / 100 - 0.2).alias("my_return"), F.lit(0.29).alias("target_return"),
                 (F.col("event_type") == "error").alias("halted"), (F.col("event_type") != "signup").alias("still_eligible"),
                 F.lit(0.25).alias("momentum_at_entry"), (F.col("value") / 200).alias("momentum_now"))
    return rounded(positions.decide(s).select("event_id", "days_left", "giveback", "action", "reason"), "giveback")


@query
def account_assessment(spark, sf):
    e = tables.table(spark, sf, "events")
    a = e.select("event_id", F.date_diff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")).alias("days_left"),
                 (F.col("value") / 100 - 0.2).alias("my_return"))
    return rounded(positions.assess(a).select("event_id", "days_left", "gap", "required_vol", "vol_now", "vol_max", "verdict"),
                   "gap", "required_vol", "vol_now", "vol_max")


# ---- quality checks

def _check(name, check, columns):
    def run(spark, sf):
        return check(tables.flawed_bars(spark, sf)).select(*columns)
    run.__name__ = name
    return query(run)


KEY = ["date", "ticker"]
_check("dq_ohlc", quality.ohlc_brackets, KEY + ["open", "high", "low", "close"])
_check("dq_positive", quality.positive_prices, KEY + ["low"])
_check("dq_duplicates", quality.duplicates, KEY + ["copies"])
_check("dq_missing", quality.missing_values, KEY + ["volume"])
_check("dq_monotonic", quality.monotonic_dates, ["ticker", "steps_back"])
_check("dq_adjustment", quality.adjustment_applied, ["ticker", "n_bars"])
_check("dq_gaps", lambda p: quality.calendar_gaps(p, GAP_DAYS), KEY + ["gap_days"])
_check("dq_zero_volume", lambda p: rounded(quality.zero_volume(p), "zero_volume_share"), ["ticker", "zero_volume_share"])
_check("dq_depth", lambda p: quality.history_depth(p, MIN_BARS), ["ticker", "n_bars"])


@query
def dq_extreme_moves(spark, sf):
    return rounded(quality.extreme_moves(tables.flawed_bars(spark, sf)).select(*KEY, "adj_ret", "near_split_ratio"), "adj_ret")


@query
def dq_summary(spark, sf):
    return quality.validate(tables.flawed_bars(spark, sf), max_gap_days=GAP_DAYS, min_bars=MIN_BARS)


# ---- repair


@query
def dq_samples(spark, sf):
    return quality.samples(tables.flawed_bars(spark, sf), 3, max_gap_days=GAP_DAYS)


# ---- repair

def _missed(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    events = tables.corporate_events(spark, sf, bars)
    return tables.unadjusted_bars(bars, events), events


@query
def split_locate(spark, sf):
    return rounded(repair.locate_recorded_splits(*_missed(spark, sf)), "observed_step", "expected_step")


@query
def split_detect(spark, sf):
    found = repair.detect_splits(*_missed(spark, sf))
    return rounded(found.select("date", "ticker", "move", "ratio", "vol_x", "drift_after", "ratio_ok", "volume_ok", "stable_after",
                                "price_ok", "confirmed", "is_split"), "move", "ratio", "vol_x", "drift_after")


@query
def split_adjust(spark, sf):
    panel, events = _missed(spark, sf)
    fixed = repair.locate_recorded_splits(panel, events).filter("needs_repair").withColumnRenamed("observed_step", "move")
    return rounded(repair.apply_split_adjustment(panel, fixed), "open", "high", "low", "close", "adj_close", "volume")


@query
def unadjusted(spark, sf):
    return repair.find_unadjusted(tables.flawed_bars(spark, sf)).select("ticker")


@query
def bad_bars(spark, sf):
    return repair.find_bad_bars(tables.flawed_bars(spark, sf)).select(*KEY, "open", "high", "low", "close")


def _landed(spark, sf):
    flawed = tables.flawed_bars(spark, sf).select("date", "ticker", "open", "high", "low", "close", "adj_close", "volume").filter(
        F.col("close").isNotNull()).dropDuplicates(KEY)
    events = tables.corporate_events(spark, sf, tables.weekly_bars(spark, sf))
    return tables.unadjusted_bars(flawed, events), events


@query
def repaired_panel(spark, sf):
    return rounded(repair.repair(*_landed(spark, sf), quarantine_unadjusted=True).panel,
                   "open", "high", "low", "close", "adj_close", "volume")


@query
def repair_report(spark, sf):
    return repair.repair_report(repair.repair(*_landed(spark, sf)))


# ---- two sources

def _sources(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    return bars, tables.second_source(spark, sf, bars)


@query
def source_compare(spark, sf):
    return rounded(reconcile.compare_panels(*_sources(spark, sf)), "max_close_diff", "max_adj_diff")


@query
def source_worst_rows(spark, sf):
    a, b = _sources(spark, sf)
    b = b.withColumn("close", F.col("close") * (1 + F.datediff("date", F.lit("1995-01-02")) / 10000))
    return rounded(reconcile.worst_rows(a, b), "close_diff", "adj_diff", "diff")


@query
def splits_applied(spark, sf):
    return rounded(reconcile.splits_missing(*_missed(spark, sf)), "adj_step")


@query
def feed_agreement(spark, sf):
    last, first = _quotes(spark, sf)
    return rounded(reconcile.quote_agreement(last, first.select("ticker", F.col("prev_close").alias("price")), 0.5)
                   .select("ticker", "gap", "agrees"), "gap")


# ---- universe

@query
def membership_asof(spark, sf):
    return universe.add_membership(tables.weekly_bars(spark, sf), tables.membership(spark, sf)).select(*KEY, "member")


@query
def membership_backfilled(spark, sf):
    panel = universe.add_membership(tables.weekly_bars(spark, sf), tables.membership(spark, sf), backfill=True)
    return panel.groupBy("date").agg(F.sum(F.col("member").cast("int")).alias("n_members"))


@query
def members_on(spark, sf):
    return universe.members_on(tables.membership(spark, sf), "1999-06-30")


@query
def liquidity(spark, sf):
    out = universe.add_liquidity(tables.weekly_bars(spark, sf), tables.WEEKLY_SCREEN)
    return rounded(out.select(*KEY, "dtv", "median_dtv", "bars_available"), "dtv", "median_dtv")


@query
def universe_members(spark, sf):
    return universe.universe_on(study(spark, sf), "1999-06-07")


@query
def universe_series(spark, sf):
    return universe.universe_series(study(spark, sf))


@query
def screened(spark, sf):
    return tables.screened_weekly(spark, sf).select(*KEY, "bars_available", *universe.SCREEN_FLAGS)


@query
def screen_summary(spark, sf):
    return universe.screen_summary(tables.screened_weekly(spark, sf))


@query
def rejections(spark, sf):
    return rounded(universe.rejection_reasons(tables.stored_study(spark, sf)).drop("close"), "median_dtv")


@query
def eligibility(spark, sf):
    return rounded(universe.eligibility_report(tables.stored_study(spark, sf)), "detail")


@query
def latest_tradable(spark, sf):
    return universe.freshness(tables.stored_study(spark, sf), "2001-12-01", 30, 5)


@query
def backfilled_share(spark, sf):
    cfg = tables.WEEKLY_SCREEN.__class__(**{**tables.WEEKLY_SCREEN.__dict__, "backfill": True, "min_history": 26})
    lists = tables.membership(spark, sf)
    return universe.backfilled_share(universe.screen(tables.weekly_bars(spark, sf), cfg, lists), lists)


# ---- factors and base rates

def _factor(name, factor):
    def run(spark, sf):
        out = factors.with_factors(study(spark, sf), [factor]).filter(F.col(factor).isNotNull())
        return rounded(out.select(*KEY, factor), factor)
    run.__name__ = name
    return query(run)


_factor("factor_momentum", "momentum")
_factor("factor_reversal", "reversal")
_factor("factor_vol", "volatility")
_factor("factor_surge", "volume_surge")


def _ranked(spark, sf, names=None):
    names = names or list(factors.FACTORS)
    return factors.percentile_ranks(factors.factor_values(study(spark, sf), names), names)


@query
def pct_rank(spark, sf):
    return rounded(factors.long_ranks(_ranked(spark, sf), list(factors.FACTORS)).drop("raw"), "pct")


@query
def composite_scores(spark, sf):
    return rounded(factors.composite_scores(_ranked(spark, sf)).drop("first_idx"), "score")


@query
def composite_components(spark, sf):
    strategy = factors.PRESETS[0]
    out = factors.composite_components(_ranked(spark, sf, [f for f, _ in strategy.weights]), strategy).drop("first_idx")
    return rounded(out, *[c for c in out.columns if c not in KEY])


@query
def top_n_signal(spark, sf):
    return factors.top_n(factors.composite_scores(_ranked(spark, sf))).select("strategy", *KEY, "place")


@query
def forward_returns(spark, sf):
    out = baserates.forward_returns(tables.weekly_bars(spark, sf)).filter(F.col("fwd_return").isNotNull())
    return rounded(out.select(*KEY, "fwd_return"), "fwd_return")


def _bucketed(spark, sf):
    ready = baserates.forward_returns(baserates.add_factor(tables.stored_study(spark, sf)))
    return baserates.bucket_cross_sectionally(ready, 10)


@query
def deciles(spark, sf):
    return _bucketed(spark, sf).select(*KEY, "bucket")


RATES = ["independent_periods", "mean", "p_positive", "p_gain_20", "p_loss_20", "p_loss_30", *baserates.QUANTILES]


@query
def base_rates(spark, sf):
    return rounded(baserates.summarise_buckets(_bucketed(spark, sf)), *RATES)


@query
def base_rates_volatility(spark, sf):
    panel = tables.stored_study(spark, sf)
    return rounded(baserates.base_rates(panel, "volatility"), *RATES)


def _today(spark, sf):
    panel = tables.stored_study(spark, sf)
    return baserates.current_buckets(panel, universe.latest_tradable(panel, 5))


@query
def current_bucket(spark, sf):
    return rounded(_today(spark, sf), "factor_value", "percentile")


@query
def decile_report(spark, sf):
    report = baserates.decile_report(_today(spark, sf), baserates.summarise_buckets(_bucketed(spark, sf)))
    return rounded(report.select("ticker", "rank", "bucket", "n", "median", "p_positive"), "median", "p_positive")


# ---- backtests

@query
def rebalance_dates(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    cal = cal_ops.calendar(bars)
    return cal_ops.schedules(cal, cal_ops.whole_history(cal, ["ME", "W-FRI", "YE"])).select(
        "schedule_id", "step", "decision_date", "exec_date")


def _backtest(spark, sf) -> backtest.BacktestResult:
    """All presets traded monthly as one job."""
    panel = study(spark, sf)
    cal = materialise(cal_ops.calendar(panel), "calendar")
    decisions = materialise(cal_ops.schedules(cal, cal_ops.whole_history(cal, ["ME"])), "decisions")
    runs = rows(spark, backtest.RUN_SCHEMA, [backtest.run_row(s.name, "ME", TRADING) for s in factors.PRESETS])
    signals = baselines.strategy_signals(panel, factors.PRESETS, decisions.select(F.col("decision_date").alias("date"), "first_idx"))
    return backtest.run_backtests(panel, cal, runs, decisions, signals.withColumnRenamed("strategy", "run_id"),
                                  TRADING.max_positions)


@query
def target_weights(spark, sf):
    return rounded(_backtest(spark, sf).targets, "weight")


@query
def turnover(spark, sf):
    return rounded(_backtest(spark, sf).turnover.select("run_id", "step", "turnover"), "turnover")


@query
def backtest_costs(spark, sf):
    return rounded(_backtest(spark, sf).steps.select("run_id", "step", "exec_date", "equity_before", "cost", "charged", "ruined"),
                   "equity_before", "cost", "charged")


@query
def trades(spark, sf):
    return rounded(_backtest(spark, sf).trades, "from_w", "to_w", "notional", "cost")


@query
def gross_returns(spark, sf):
    """Returns net of the fill-day cost."""
    return rounded(_backtest(spark, sf).returns.select("run_id", "date", "ret"), "ret")


@query
def equity_curve(spark, sf):
    equity = F.when(F.col("equity") > 0, F.log("equity")).alias("log_equity")
    return rounded(_backtest(spark, sf).returns.select("run_id", "date", equity), "log_equity")


@query
def backtest_summary(spark, sf):
    return rounded(_backtest(spark, sf).summary, "cost_drag", "avg_turnover")


def _preset_signal(panel: DataFrame, decisions: DataFrame) -> DataFrame:
    known = decisions.select(F.col("decision_date").alias("date"), "first_idx")
    return baselines.strategy_signals(panel, factors.PRESETS[1:2], known)


@query
def run_signal(spark, sf):
    """One signal over all history, as a user of the backtest calls it."""
    return rounded(backtest.run_signal(study(spark, sf), _preset_signal, TRADING, factors.PRESETS[1].name).returns.select("run_id", "date", "ret"), "ret")


LOOKAHEAD_CUTS = ["1998-06-30", "2000-01-31"]


@query
def signal_lookahead(spark, sf):
    return backtest.lookahead_report(study(spark, sf), _preset_signal, LOOKAHEAD_CUTS)


STATS = ["total_return", "cagr", "vol", "sharpe", "sortino", "max_dd", "calmar", "hit_rate", "skew", "kurt"]


def _ticker_runs(spark, sf):
    """Every ticker's own returns as a run."""
    return prices.add_returns(tables.weekly_bars(spark, sf)).select(F.col("ticker").alias("run_id"), "date", "ret")


@query
def metrics_summary(spark, sf):
    return rounded(metrics.summarise(_ticker_runs(spark, sf)), *STATS)


@query
def strategies_compared(spark, sf):
    """The presets side by side, with what each turned over."""
    result = _backtest(spark, sf)
    traded = result.turnover.groupBy("run_id").agg(F.avg("turnover").alias("avg_turnover"))
    table = metrics.compare(metrics.summarise(result.returns).select("run_id", "n_periods", "vol", "sharpe", "max_dd", "hit_rate"), traded)
    return rounded(table, "vol", "sharpe", "max_dd", "hit_rate", "avg_turnover")


@query
def drawdown_series(spark, sf):
    runs = _ticker_runs(spark, sf)
    return rounded(metrics.drawdowns(runs).select("run_id", "date", "drawdown"), "drawdown")


@query
def deflated_sharpe(spark, sf):
    return rounded(metrics.summarise(_ticker_runs(spark, sf), n_trials=100).select("run_id", "sharpe", "dsr_z"), "sharpe", "dsr_z")


@query
def deflated_sharpe_probability(spark, sf):
    return rounded(metrics.summarise(_ticker_runs(spark, sf), n_trials=100).select("run_id", "dsr"), "dsr")


@query
def random_trials(spark, sf):
    out = baselines.random_trials(study(spark, sf), TRADING, N_NAMES, N_RANDOM, 7, "1998-01-05")
    return rounded(logged(out, total_return="log_growth", cagr="log_cagr"), "log_growth", "log_cagr", "sharpe", "max_dd", "vol")


@query
def baseline_table(spark, sf):
    table = baselines.baseline_table(study(spark, sf), factors.PRESETS[1], TRADING, N_RANDOM, N_NAMES, 7)
    return rounded(logged(table, total_return="log_growth", cagr="log_cagr"), "log_growth", "log_cagr", "vol", "sharpe", "max_dd",
                   "avg_turnover", "cost_drag", "pctile_vs_random")


# ---- walk-forward

def _walk(spark, sf):
    return walkforward.walk_forward(study(spark, sf), factors.PRESETS, TRADING, **WF)


@query
def wf_splits(spark, sf):
    return walkforward.make_splits(cal_ops.calendar(tables.weekly_bars(spark, sf)), **WF)


@query
def wf_candidates(spark, sf):
    return rounded(logged(_walk(spark, sf).candidates, train_return="train_log_growth"), "train_sharpe", "train_log_growth")


@query
def wf_folds(spark, sf):
    return rounded(logged(_walk(spark, sf).folds, oos_return="oos_log_growth"), "is_sharpe", "oos_sharpe", "oos_log_growth", "oos_maxdd")


@query
def wf_oos(spark, sf):
    return rounded(_walk(spark, sf).oos, "ret")


@query
def wf_summary(spark, sf):
    return rounded(logged(_walk(spark, sf).summary, stitched_return="stitched_log_growth"), "mean_is", "mean_oos", "degradation",
                   "stitched_sharpe", "stitched_log_growth", "stitched_maxdd")


@query
def wf_rolling(spark, sf):
    walk = walkforward.walk_forward(study(spark, sf), factors.PRESETS, TRADING, expanding=False, **{**WF, "train_months": 48})
    return rounded(logged(walk.folds, oos_return="oos_log_growth"), "is_sharpe", "oos_sharpe", "oos_log_growth", "oos_maxdd")


@query
def holdout(spark, sf):
    out = walkforward.evaluate_holdout(study(spark, sf), factors.PRESETS[1], TRADING, 12, 3)
    return rounded(logged(out, total_return="log_growth"), "sharpe", "log_growth", "max_dd", "dsr_z", "dsr")


# ---- concentrated portfolios

def _scores(spark, sf, lookback=WINDOW.lookback):
    panel = study(spark, sf)
    starts = concentration.start_range(concentration.spans_all(panel), WINDOW.horizon, lookback)
    windows = concentration.window_rows_table(panel, WINDOW.horizon, lookback)
    offers = concentration.candidates(windows, starts, WINDOW.min_names)
    return concentration.rule_scores(offers, concentration.RULES, WINDOW.seed, lookback)


@query
def window_returns(spark, sf):
    out = study(spark, sf).withColumn("fwd", concentration.window_return(WINDOW.horizon)).filter(F.col("fwd").isNotNull())
    return rounded(out.select(*KEY, "fwd"), "fwd")


@query
def rule_scores(spark, sf):
    return rounded(_scores(spark, sf).select(*KEY, "rule", "score"), "score")


@query
def rule_scores_short(spark, sf):
    """Under ten dates of history every rule scores at random."""
    return rounded(_scores(spark, sf, SHORT_LOOKBACK).select(*KEY, "rule", "score"), "score")


@query
def leaderboard(spark, sf):
    held = concentration.top_k_portfolios(_scores(spark, sf), (1, 3, 5), WINDOW.seed)
    return rounded(concentration.leaderboard(held).drop("span", "date_idx"), "portfolio_return", "win_credit")


def _live(spark, sf):
    panel = study(spark, sf)
    return concentration.rank_universe(panel, universe.latest_tradable(panel, 5), "momentum", 26)


@query
def live_ranking(spark, sf):
    return rounded(_live(spark, sf).select("ticker", "score"), "score")


@query
def live_pick(spark, sf):
    best = concentration.pick(concentration.enrich(_live(spark, sf), 10_000.0, BANK_LOW), 1, 10)
    return rounded(best.select("place", "role", "ticker", "score", "lots", "notional", "cash_left", "roundtrip_pct"),
                   "score", "notional", "cash_left", "roundtrip_pct")


# ---- the flagship: who led on each rebalance date

@query
def rebalance_leaders(spark, sf):
    panel = study(spark, sf)
    cal = cal_ops.calendar(panel)
    dates = cal_ops.schedules(cal, cal_ops.whole_history(cal, ["ME"])).select(F.col("decision_date").alias("date"))
    ranked = panel.withColumn("score", concentration.prior_momentum(60)).filter("eligible and score is not null")
    order = W.partitionBy("date").orderBy(F.col("score").desc(), "ticker")
    led = ranked.join(dates, "date", "left_semi").withColumn("place", F.row_number().over(order)).filter("place <= 3")
    return rounded(led.select(*KEY, "place", "score"), "score")
