"""Ingest, quality, repair, reconciliation and the universe screen on planted faults."""

import datetime as dt
import json

import pytest
from panels import bars, days, ramp
from pyspark.sql import functions as F

from panelspark.operators import quality, reconcile, repair, universe
from panelspark.schemas import ScreenConfig
from panelspark.sources import ingest, listtext, payload, sinks


def clean(spark):
    return bars(spark, {"AAA": ramp(200, 2, 3), "BBB": ramp(200, 3, 4)}).withColumn("seq", F.unix_date("date"))


def failing(panel, **kw):
    return {r["check"]: r.n_bad for r in quality.validate(panel, **kw).filter("not passed").collect()}


def test_clean_panel_passes(spark):
    assert failing(clean(spark)) == {}
    quality.assert_clean(clean(spark))


@pytest.mark.parametrize("fault,check,n", [
    (lambda p: p.withColumn("high", F.when((F.col("ticker") == "AAA") & (F.col("seq") == F.lit(18302)), 0.5).otherwise(F.col("high"))), "OHLC brackets", 1),
    (lambda p: p.withColumn("close", F.when((F.col("ticker") == "AAA") & (F.col("seq") == F.lit(18302)), None).otherwise(F.col("close"))), "no missing values", 1),
    (lambda p: p.unionByName(p.filter("ticker = 'AAA' and seq = 18302")), "no duplicates", 2),
    (lambda p: p.withColumn("adj_close", F.when(F.col("ticker") == "AAA", F.col("close")).otherwise(F.col("adj_close"))), "adjustment applied", 1),
    (lambda p: p.withColumn("volume", F.when(F.col("ticker") == "AAA", 0.0).otherwise(F.col("volume"))), "zero-volume bars", 1),
    (lambda p: p.withColumn("seq", F.when((F.col("ticker") == "AAA") & (F.col("seq") == F.lit(18302)), 0).otherwise(F.col("seq"))), "monotonic dates", 1)])
def test_planted_faults(spark, fault, check, n):
    assert failing(fault(clean(spark))).get(check) == n
    with pytest.raises(ValueError, match=check):
        quality.assert_clean(fault(clean(spark)))


def test_gap_and_depth(spark):
    p = clean(spark)
    holed = p.filter(~((F.col("ticker") == "AAA") & F.col("date").between("2020-03-01", "2020-04-01")))
    assert failing(holed) == {"calendar gaps": 1}
    assert failing(p.filter("ticker = 'BBB' or seq < 18300")).get("history depth") == 1


def unadjusted(spark, ratio, at=150):
    closes = [c / ratio if i >= at else c for i, c in enumerate(ramp())]
    return bars(spark, {"AAA": closes, "BBB": ramp()})


def events(spark, *rows):
    return spark.createDataFrame([(days(300)[at + late], t, float(v)) for t, at, late, v in rows], "date DATE, ticker STRING, value DOUBLE")


@pytest.mark.parametrize("ratio", [1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 1.995, 2.014, 0.2])
def test_missed_split_is_found_and_repaired(spark, ratio):
    panel = unadjusted(spark, ratio)
    ev = events(spark, ("AAA", 150, 20, ratio))
    result = repair.repair(panel, ev)
    fixed = result.fixed.collect()
    assert len(fixed) == 1 and fixed[0].date == days(300)[150]
    moved = quality.extreme_moves(result.panel).count()
    assert moved == 0
    again = repair.repair(result.panel, ev)
    assert again.fixed.count() == 0
    before = panel.filter("ticker = 'AAA'").orderBy("date").first()
    after = result.panel.filter("ticker = 'AAA'").orderBy("date").first()
    assert after.close == pytest.approx(before.close / ratio) and after.volume == pytest.approx(before.volume * ratio)


def test_pattern_detector_gates(spark):
    assert [r.is_split for r in repair.detect_splits(unadjusted(spark, 2.0)).collect()] == [True]
    penny = bars(spark, {"AAA": [0.02 if i % 2 else 0.03 for i in range(300)]}, volume=5e4)
    found = repair.detect_splits(penny)
    assert found.count() > 100 and found.filter("is_split").count() == 0 and found.filter("ratio_ok").count() > 0
    rally = [c * (1.541 * 1.15 ** min(max(i - 150, 0), 3) if i >= 150 else 1) for i, c in enumerate(ramp())]
    assert repair.detect_splits(bars(spark, {"AAA": rally})).filter("is_split").count() == 0


def test_event_recorded_twice_counts_once(spark):
    panel = unadjusted(spark, 2.0)
    twice = events(spark, ("AAA", 150, 0, 2.0), ("AAA", 150, 0, 2.0000000001))
    assert repair.locate_recorded_splits(panel, twice).count() == 1
    assert repair.locate_recorded_splits(panel, events(spark, ("AAA", 150, 0, 2.0), ("AAA", 150, 0, 1.1))).count() == 2
    assert ingest.merge_events(twice, twice).count() == 1


def test_already_applied_split_is_left_alone(spark):
    result = repair.repair(bars(spark, {"AAA": ramp()}), events(spark, ("AAA", 150, 0, 2.0)))
    assert result.fixed.count() == 0 and result.located.count() == 1
    report = {r.outcome: r.n for r in repair.repair_report(result).collect()}
    assert report["already applied"] == 1 and report["splits fixed"] == 0


def test_bad_bar_takes_its_copies_and_quarantine_is_opt_in(spark):
    p = bars(spark, {"AAA": ramp(), "BBB": ramp()}).withColumn("adj_close", F.when(F.col("ticker") == "BBB", F.col("close")).otherwise(F.col("adj_close")))
    copy = p.filter(f"ticker = 'AAA' and date = '{days(300)[10]}'")
    dirty = p.unionByName(copy.withColumn("low", F.lit(-1.0)))
    result = repair.repair(dirty)
    assert result.panel.count() == 599 and result.unadjusted.count() == 1 and result.dropped.count() == 1
    assert repair.drop_bad_bars(dirty).count() == 599
    assert repair.repair(dirty, quarantine_unadjusted=True).panel.select("ticker").distinct().count() == 1


def test_reconciliation(spark):
    a = bars(spark, {"AAA": ramp(100), "BBB": ramp(100), "ONLY": ramp(100)})
    b = (a.filter("ticker <> 'ONLY'").filter(F.col("date") < F.lit(days(100)[90]))
         .withColumn("adj_close", F.when((F.col("ticker") == "BBB") & (F.col("date") >= F.lit(days(100)[50])), F.col("adj_close") / 2).otherwise(F.col("adj_close"))))
    got = {r.ticker: r for r in reconcile.compare_panels(a, b).collect()}
    assert set(got) == {"AAA", "BBB"}
    assert got["AAA"].clean and got["AAA"].only_a == 10 and got["AAA"].common_bars == 90
    assert got["BBB"].material and got["BBB"].adj_mismatches == 40 and got["BBB"].max_adj_diff == pytest.approx(1.0)
    worst = reconcile.worst_rows(a, b).collect()
    assert len(worst) == 5 and {r.ticker for r in worst} == {"BBB"}


def test_split_visibility(spark):
    seen = {r.ticker: r.applied for r in reconcile.splits_missing(unadjusted(spark, 2.0), events(spark, ("AAA", 150, 3, 2.0), ("BBB", 150, 3, 2.0))).collect()}
    assert seen == {"AAA": False, "BBB": True}
    cons = unadjusted(spark, 0.2)
    ev = events(spark, ("AAA", 150, 3, 0.2))
    assert reconcile.splits_missing(cons, ev).first().applied
    assert not reconcile.splits_missing(cons, ev, invert_consolidations=True).first().applied


def lists(spark):
    d = dt.date
    return spark.createDataFrame([(d(2024, 5, 30), "AAA"), (d(2024, 5, 30), "OUT"), (d(2024, 11, 28), "AAA"), (d(2024, 11, 28), "BBB")], "list_date DATE, ticker STRING")


@pytest.mark.parametrize("date,backfill,want", [
    ("2024-05-29", False, set()), ("2024-05-29", True, {"AAA", "OUT"}), ("2024-05-30", False, {"AAA", "OUT"}), ("2024-11-27", False, {"AAA", "OUT"}),
    ("2024-11-28", False, {"AAA", "BBB"}), ("2030-01-01", False, {"AAA", "BBB"})])
def test_membership_in_force(spark, date, backfill, want):
    assert {r.ticker for r in universe.members_on(lists(spark), date, backfill).collect()} == want
    panel = spark.createDataFrame([(dt.date.fromisoformat(date), t) for t in ("AAA", "BBB", "OUT")], "date DATE, ticker STRING")
    got = universe.add_membership(panel, lists(spark), backfill).filter("member").collect()
    assert {r.ticker for r in got} == want


def test_liquidity_excludes_today(spark):
    p = bars(spark, {"AAA": [2.0] * 200}, volume=1e3)
    spike = p.withColumn("volume", F.when(F.col("date") == F.lit(days(200)[150]), 1e10).otherwise(F.col("volume")))
    got = universe.add_liquidity(spike).orderBy("date").collect()
    assert got[150].median_dtv == 2000 and got[29].median_dtv is None and got[30].median_dtv == 2000 and got[150].bars_available == 150


def test_screen_thresholds_and_required_lists(spark):
    p = bars(spark, {"AAA": [2.0] * 200, "DEAR": [60.0] * 200, "THIN": [2.0] * 200}).withColumn(
        "volume", F.when(F.col("ticker") == "THIN", 10.0).otherwise(F.col("volume")))
    out = universe.screen(p, ScreenConfig(require_membership=False))
    assert {r.ticker for r in out.filter("eligible").select("ticker").distinct().collect()} == {"AAA"}
    assert out.filter("eligible").count() == 80
    with pytest.raises(ValueError):
        universe.screen(p)
    last = str(days(200)[199])
    assert [r.ticker for r in universe.universe_on(out, last).collect()] == ["AAA"]
    assert universe.rejection_reasons(out, last).count() == 3
    assert universe.eligibility_report(out.filter(f"date = '{last}' and ticker = 'THIN'")).filter("not passed").first().condition == "liquid"


def test_ragged_edge(spark):
    p = bars(spark, {f"T{i:02d}": [2.0] * 100 for i in range(80)}).unionByName(bars(spark, {f"T{i:02d}": [2.0] * 101 for i in range(3)}).filter(
        F.col("date") == F.lit(days(101)[100])))
    out = universe.screen(p, ScreenConfig(require_membership=False, min_history=10))
    got = universe.freshness(out, str(days(101)[100]), 10).first()
    assert got.as_of == days(101)[99] and got.ragged_edge and got.fresh


def test_normalise_and_upsert(spark):
    raw = spark.createDataFrame([("2020-01-01", "0001", "1", "2", "1", "1.5", "x"), ("2020-01-01", "0001", "9", "9", "9", "9", "9"),
                                 ("2020-01-02", "0001", "1", "2", "1", "bad", "5")], "Date STRING, ticker STRING, Open STRING, High STRING, Low STRING, Close STRING, Volume STRING")
    got = ingest.normalise(raw.withColumn("n", F.monotonically_increasing_id()), "n").collect()
    assert len(got) == 1 and got[0].ticker == "0001.KL" and got[0].close == 1.5 and got[0].adj_close == 1.5 and got[0].volume is None
    old, new = bars(spark, {"A": [1.0, 2.0, 3.0]}), bars(spark, {"A": [1.0, 2.0, 9.0, 4.0]}).filter("close >= 4")
    assert [r.close for r in ingest.upsert_fresh_wins(old, new).orderBy("date").collect()] == [1.0, 2.0, 9.0, 4.0]


def test_payload_decoding(spark):
    doc = {"timestamp": [0, 86400, 172800], "indicators": {"quote": [{"open": [1, 2, 3], "high": [1, 2, 3], "low": [1, 2, 3], "close": [1.5, None, 3.5], "volume": [10, 20, None]}]},
           "events": {"splits": {"86400": {"numerator": 1, "denominator": 5}}, "dividends": {"172800": {"amount": 0.1}}}}
    p = spark.createDataFrame([("A", json.dumps(doc), None), ("B", None, "timeout")], "ticker STRING, payload STRING, error STRING")
    got = payload.payload_bars(p).orderBy("date").collect()
    assert [(str(r.date), r.close, r.adj_close, r.volume) for r in got] == [("1970-01-01", 1.5, 1.5, 10), ("1970-01-03", 3.5, 3.5, 0)]
    assert payload.payload_events(p).first().value == pytest.approx(0.2)
    assert payload.payload_events(p, "dividends").first().value == pytest.approx(0.1)


def test_list_text(spark):
    text = "\n".join(["  1.   9901   Delta One", "LIST OF SHARIAH-COMPLIANT SECURITIES - MAIN", "  1.   0001   Alpha Bhd      2.   03065   Beta Tech",
                      "  3.   5183   Chem Group      4.   0001   Alpha Bhd", "ADDITIONAL LIST", "  1.   9801   Fund"])
    docs = spark.createDataFrame([("d", text), ("none", "  1.   0001   Alpha")], "doc_id STRING, text STRING")
    got = listtext.list_codes(listtext.list_section(listtext.text_lines(docs))).orderBy("line_no", "at").collect()
    assert [r.code for r in got] == ["0001", "03065", "5183"] and not got[0].plausible


def test_files_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "m.csv").write_text("list_date,ticker\n2024-05-30,0001\n2024-05-30,03065\n2024-05-30,0001\n")
    assert {r.ticker for r in ingest.load_membership(spark, str(tmp_path / "m.csv")).collect()} == {"0001.KL", "03065.KL"}
    (tmp_path / "c.csv").write_text("code\n 12\n03065\n0012\n")
    assert [r.code for r in ingest.load_candidates(spark, str(tmp_path / "c.csv")).collect()] == ["0012", "03065"]
    with pytest.raises(ValueError, match="ticker"):
        (tmp_path / "x.csv").write_text("list_date\n2024-05-30\n")
        ingest.load_membership(spark, str(tmp_path / "x.csv"))


def test_sinks(spark, tmp_path):
    where = str(tmp_path / "lists")
    sinks.replace_snapshot(lists(spark), where)
    sinks.replace_snapshot(lists(spark).filter("ticker = 'BBB'"), where)
    got = {(str(r.list_date), r.ticker) for r in spark.read.parquet(where).collect()}
    assert got == {("2024-05-30", "AAA"), ("2024-05-30", "OUT"), ("2024-11-28", "BBB")}
    panel = bars(spark, {"AAA": ramp(20)})
    sinks.write_panel(panel, str(tmp_path / "p"), by_year=True)
    assert ingest.load_panel(spark, str(tmp_path / "p"), ["AAA"]).count() == 20
    pick = spark.createDataFrame([("A", 1.0, 2, 200.0, 0.5)], "ticker STRING, price DOUBLE, lots BIGINT, notional DOUBLE, score DOUBLE")
    for decision in ("mon", "tue", "mon"):  # the first is tried twice
        sinks.record_decision(pick, str(tmp_path / "log"), decision, "momentum", 1000.0)
    assert sorted(r.decision for r in sinks.read_journal(spark, str(tmp_path / "log")).collect()) == ["mon", "tue"]
    sinks.write_verified(ingest.load_summary(panel.select("ticker").distinct(), panel), str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).first().code == "AAA"


def test_build_writes_clean_and_screened_tables(spark, tmp_path):
    from panelspark.plans.build import build_panel

    panel = bars(spark, {"AAA": [c / 2 if i >= 150 else c for i, c in enumerate(ramp())], "BBB": ramp()})
    members = spark.createDataFrame([(days(300)[200], "AAA")], "list_date DATE, ticker STRING")
    built = build_panel(panel, str(tmp_path / "clean"), events(spark, ("AAA", 150, 3, 2.0)), members, str(tmp_path / "screened"))
    assert built.clean.count() == 600 and built.checks.filter("not passed").count() == 0
    share = built.backfilled.first()
    assert (share.n_eligible, share.n_point_in_time, share.n_names) == (180, 100, 1)
    assert spark.read.parquet(str(tmp_path / "screened")).filter("eligible").count() == 180


def test_refusals(spark):
    empty = spark.createDataFrame([("B", None, "timeout")], "ticker STRING, payload STRING, error STRING")
    with pytest.raises(ValueError, match="no payload"):
        payload.landed_panel(empty)
    short = listtext.list_codes(spark.createDataFrame([("d", 1, "  1.   0001   Alpha")], "doc_id STRING, line_no INT, line STRING"))
    with pytest.raises(ValueError, match="only 1 codes"):
        listtext.assert_plausible(short)


def test_clean_panel_without_arrival_order(spark):
    panel = clean(spark).drop("seq")
    quality.assert_clean(panel, allow=("extreme moves", "calendar gaps", "monotonic dates"))
    unrun = quality.validate(panel).filter("check = 'monotonic dates'").first()
    assert unrun.passed is None and unrun.n_bad is None


def test_repair_with_an_empty_record_lets_the_detector_decide(spark):
    from panels import bars
    from panelspark.operators import repair

    level = [10.0 + 0.01 * (i % 5) for i in range(80)]
    panel = bars(spark, {"A": level[:40] + [v / 2 for v in level[40:]], "B": level})
    none = spark.createDataFrame([], "date DATE, ticker STRING, value DOUBLE")
    fixed = [{r.ticker for r in repair.repair(panel, events).fixed.collect()} for events in (None, none)]
    assert fixed[0] == fixed[1] == {"A"}


def test_unlike_files_and_broken_lines(spark, tmp_path):
    days_ = [dt.date(2024, 1, d) for d in (2, 3)]
    spark.createDataFrame([(d, "1", 1.0, 5) for d in days_], "Date DATE, ticker STRING, Close DOUBLE, volume BIGINT").write.parquet(str(tmp_path / "raw/a"))
    spark.createDataFrame([(days_[0], "2", 2.0, 1.9)], ["date", "ticker", "close", "Adj Close"]).write.parquet(str(tmp_path / "raw/b"))
    got = {(r.date, r.ticker): r for r in ingest.load_raw(spark, str(tmp_path / "raw/*")).collect()}
    assert len(got) == 3 and got[days_[0], "2"].adj_close == 1.9 and got[days_[1], "1"].close == 1.0 and got[days_[1], "1"].adj_close is None
    (tmp_path / "e.csv").write_text("date,ticker,value\n2024-01-02,0001,2.0\nsoon,0002,1.5\n2024-01-04,0003,half\n")
    read = ingest.load_events(spark, str(tmp_path / "e.csv"))
    one = ingest.events_profile(read).first()
    assert (one.n_lines, one.n_bad, one.n_tickers, one.n_usable) == (3, 2, 3, 1)
    assert {r.bad_record for r in read.collect()} == {None, "soon,0002,1.5", "2024-01-04,0003,half"}
    (tmp_path / "m.csv").write_text("ticker,list_date\n0001,2024-05-30\n0002,n/a\n")
    assert [r.ticker for r in ingest.load_membership(spark, str(tmp_path / "m.csv"), skip_undated=True).collect()] == ["0001.KL"]
    with pytest.raises(Exception, match="n/a"):
        ingest.load_membership(spark, str(tmp_path / "m.csv")).collect()


def test_samples_are_the_smallest_of_each_check_in_one_scan(spark):
    panel = bars(spark, {t: ramp(150) for t in ("A", "B", "C")}).withColumn("seq", F.unix_date("date"))
    broken = panel.withColumn("high", F.when(F.dayofmonth("date") == 10, 0.1).otherwise(F.col("high")))
    broken = broken.unionByName(broken.filter("ticker = 'C'"))
    got = quality.samples(broken, 2)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.check, []).append((r.ticker, r.date))
    want = sorted((r.ticker, r.date) for r in broken.filter("dayofmonth(date) = 10").select("ticker", "date").distinct().collect())[:2]
    assert sorted(rows["OHLC brackets"]) == want
    assert sorted(rows["no duplicates"]) == sorted((r.ticker, r.date) for r in panel.filter("ticker = 'C'").orderBy("date").limit(2).collect())
    with pytest.raises(ValueError, match="OHLC brackets"):
        quality.assert_clean(broken)
