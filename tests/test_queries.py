"""Every registered query against its SQL on the small tables, plus the streaming twins."""

import pytest
from panels import SF
from oracle_check import connection, differences
from pyspark.sql import functions as F

from panelspark.plans.oracle import ORACLES
from panelspark.plans.queries import QUERIES
from panelspark.streaming import bars as stream_bars



@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert not differences(got, con.execute(ORACLES[name]).fetchdf())


def test_trials_and_folds_are_all_there(spark):
    assert QUERIES["random_trials"](spark, SF).count() == 200
    assert QUERIES["wf_splits"](spark, SF).count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_streamed_upsert_replaces_and_keeps_other_years(spark, tmp_path):
    from panels import bars
    from panelspark.schemas import BARS

    src = tmp_path / "in"
    old = bars(spark, {"A": [1.0] * 300})
    old.coalesce(1).write.parquet(str(src / "one"))
    path, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def drain():
        stream = spark.readStream.schema(BARS).option("recursiveFileLookup", True).parquet(str(src))
        stream_bars.upsert_batches(stream.where("close is not null"), path, mark, spark).awaitTermination()
        return stream_bars.read_upserted(spark, path)

    assert drain().count() == 300
    bars(spark, {"A": [1.0] * 299 + [7.0, 8.0]}).filter("close > 1").coalesce(1).write.parquet(str(src / "two"))
    got = drain()
    assert got.count() == 301 and got.filter("close > 1").count() == 2


def test_a_batch_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from panels import bars
    from panelspark.schemas import BARS

    src, path, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def drain():
        stream = spark.readStream.schema(BARS).option("recursiveFileLookup", True).parquet(str(src))
        stream_bars.upsert_batches(stream, path, mark, spark).awaitTermination()

    bars(spark, {"A": [1.0] * 300}).coalesce(1).write.parquet(str(src / "one"))
    drain()
    before = stream_bars.read_upserted(spark, path)
    bars(spark, {"A": [2.0] * 300}).coalesce(1).write.parquet(str(src / "two"))

    def killed(*_):
        raise RuntimeError("killed before the commit")

    with monkeypatch.context() as m:
        m.setattr(stream_bars, "_commit", killed)
        with pytest.raises(Exception, match="killed before the commit"):
            drain()
    held = len(list((tmp_path / "out").glob("version=*")))
    assert held == 2 and stream_bars.read_upserted(spark, path).filter("close = 1").count() == 300
    drain()
    assert stream_bars.read_upserted(spark, path).filter("close = 2").count() == 300
    assert before.filter("close = 1").count() == 300  # a reader that was pinned to the version before
    assert len(list((tmp_path / "out").glob("version=*"))) == 2  # what the dead batch left is gone


def test_a_committed_batch_repeated_changes_nothing(spark, tmp_path):
    from panels import bars

    path = str(tmp_path / "out")
    src = tmp_path / "in"
    bars(spark, {"A": [1.0] * 30}).coalesce(1).write.parquet(str(src / "one"))
    for mark in ("a", "b"):  # a new checkpoint numbers the same batch 0 again
        stream = spark.readStream.schema("date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume DOUBLE").option(
            "recursiveFileLookup", True).parquet(str(src))
        stream_bars.upsert_batches(stream, path, str(tmp_path / mark), spark).awaitTermination()
    assert stream_bars.read_upserted(spark, path).count() == 30 and len(list((tmp_path / "out").glob("version=*"))) == 1


def test_quotes_go_stale_without_a_new_one(spark, tmp_path):
    """A ticker is reported when time has passed, not when it is quoted again; state holds open sessions only."""
    import datetime as dt
    import time

    from panelspark.streaming import quotes as q

    schema = "ticker STRING, event_id BIGINT, price DOUBLE, quoted_at TIMESTAMP, error STRING"
    src, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    t0 = dt.datetime(2024, 1, 1, 9, 0)

    def land(name, rows):
        spark.createDataFrame([(t, i, p, t0 + dt.timedelta(minutes=m), None) for i, (t, m, p) in enumerate(rows)], schema).coalesce(1).write.parquet(str(src / name))
        time.sleep(1.1)
        stale = q.gone_stale(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src)), "10 minutes", "1 minute")
        query = stale.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return state, sorted((r.ticker, r.stale_at, r.last_price) for r in spark.read.schema(stale.schema).parquet(str(out)).collect())

    state, got = land("one", [("A", 0, 1.0), ("A", 5, 2.0), ("B", 0, 3.0), ("C", 20, None)])
    assert got == []
    state, got = land("two", [("D", 30, 4.0), ("B", 8, 5.0)])
    assert got == [("A", t0 + dt.timedelta(minutes=15), 2.0), ("B", t0 + dt.timedelta(minutes=18), 5.0)] and state == 1
    for n in range(3, 7):  # others go on, A and B are not held
        state, got = land(f"more{n}", [("D", 10 * n + 5, 1.0)])
        assert state <= 2
    assert len([g for g in got if g[0] in "AB"]) == 2


def test_a_replay_frees_closed_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in stream_bars.replay_by_time(spark, SF, path, "14 days", 4)]
    table = stream_bars.read_upserted(spark, path)
    tickers, bars_ = table.select("ticker").distinct().count(), table.count()
    assert len(held) == 4 and max(held) <= 4 * tickers < bars_ / 4


def test_streams_read_tables_of_many_files(spark, tmp_path):
    for name in ("lineitem", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("streamed_bars", "streamed_bad_bars", "streamed_quotes"):
        one, many = (QUERIES[name](spark, d).toPandas() for d in (SF, str(tmp_path)))
        assert len(one) and not differences(many, one), name


def test_upserted_table_before_the_first_batch_is_empty(spark, tmp_path):
    assert stream_bars.read_upserted(spark, str(tmp_path / "nothing")).count() == 0


def test_stored_study_follows_its_tables(spark, tmp_path):
    for name in ("lineitem", "supplier", "nation", "part", "orders", "customer", "region", "events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = QUERIES["rejections"](spark, str(tmp_path)).count()
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert 0 < QUERIES["rejections"](spark, str(tmp_path)).count() < before


def test_a_stream_of_trades_is_exchanged_once_as_it_is(spark):
    """Trades lie where the state of their bar is: no split is sorted and combined before the exchange."""
    ticks = stream_bars.ticks_stream(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "14 days")
    bars = stream_bars.line_bars(ticks, parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    query = bars.writeStream.format("noop").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False).splitlines()
    exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(exchanges) == 1 and not any("Aggregate" in line for line in plan[exchanges[0]:])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[-1] < max(held) / 4  # the watermark is kept


def test_tasks_of_an_upsert_follow_its_rows(spark, con, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_bars, "MERGED_ROWS", 10, raising=False)
    path = str(tmp_path / "bars")
    for _ in stream_bars.replay_by_time(spark, SF, path, "14 days", 4):
        pass
    files = [len(list(year.glob("*.parquet"))) for year in (tmp_path / "bars").glob("version=*/year=*")]
    assert max(files) > 8
    got = stream_bars.read_upserted(spark, path).toPandas()
    assert not differences(got, con.execute(ORACLES["streamed_bars_late"]).fetchdf())
