"""Bars from a stream of trades: tumbling windows, fresh-wins upsert, stateless checks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.quality import bad_brackets, has_missing, not_positive
from panelspark.scratch import materialise, release, scratch_path
from panelspark.schemas import BARS, BAR_COLUMNS
from panelspark.sources.ingest import upsert_by_year
from panelspark.sources.tables import LINE_COLUMNS, line_bars, line_ticks, ticker_of

# Bars that one task of an upsert merges, and the fewest tasks of one.
MERGED_ROWS, LEAST_PARTS = 1 << 18, 8


def ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a stream of trades.  Files that hold all times have no watermark, so that no trade is dropped."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    return line_ticks(spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parquet*"))  # a file, or a folder of files


def _state_parts(spark: SparkSession) -> int:
    """Partitions of a new stream's state: trades dealt by bar into as many lie where their state is."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def upsert_batches(bars: DataFrame, path: str, checkpoint: str, spark: SparkSession):
    """Merge each micro-batch into a table partitioned by year; only touched years are rewritten.

    Every attempt at a batch writes a version folder of its own; a manifest that names the finished version of each year is
    written last and appears whole.  Readers follow the newest manifest, so a batch that dies half way leaves the table as it
    was, and a batch repeated after it was committed changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        held = _manifests(session, path)
        if batch_id in held:
            return
        fresh = materialise(batch.select(*BAR_COLUMNS), "batch")
        touched = {r.year: r.n for r in fresh.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).collect()}  # one row per touched year
        last = _read_manifest(session, path, max(held)) if held else {}
        version = f"version={batch_id}-{uuid.uuid4().hex}"
        if touched:  # a batch that only frees state has no bars
            before = _read_versions(session, path, {y: v for y, v in last.items() if int(y) in touched})
            parts = max(LEAST_PARTS, -(-(sum(touched.values()) + before.count()) // MERGED_ROWS))
            upsert_by_year(before, fresh, parts).write.partitionBy("year").parquet(f"{path}/{version}")
        release(fresh)
        _commit(session, path, batch_id, last | {str(y): version for y in touched})
        _drop_superseded(session, path, batch_id)

    return (bars.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that names paths below it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *names: hadoop.Path("/".join([path, *names]))


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The batches that are committed: two at most are kept, and one may be under way."""
    files, at = _files(spark, path)
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.globStatus(at("_manifest", "*.json")) or [])


def _read_manifest(spark: SparkSession, path: str, batch_id: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{path}/_manifest/{batch_id:012d}.json", wholetext=True).first().value)


def _commit(spark: SparkSession, path: str, batch_id: int, versions: dict[str, str]) -> None:
    """Written aside, then renamed: a manifest is there whole or not at all."""
    files, at = _files(spark, path)
    aside = at("_manifest", f".{batch_id}-{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
    out.close()
    if not files.rename(aside, at("_manifest", f"{batch_id:012d}.json")):
        raise RuntimeError(f"could not commit batch {batch_id} of {path}")


def _read_versions(spark: SparkSession, path: str, versions: dict[str, str]) -> DataFrame:
    where = [f"{path}/{version}/year={year}" for year, version in sorted(versions.items())]
    return spark.read.schema(BARS).parquet(*where) if where else spark.createDataFrame([], BARS)


def read_upserted(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """The table as of the last committed batch, or as of one that is still kept; empty before the first one."""
    held = _manifests(spark, path)
    if batch_id is None and not held:
        return spark.createDataFrame([], BARS)
    return _read_versions(spark, path, _read_manifest(spark, path, max(held) if batch_id is None else batch_id))


def _drop_superseded(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what neither this batch nor the one before it names: replaced versions, and what a batch that died left behind."""
    files, at = _files(spark, path)
    kept = [b for b in _manifests(spark, path) if b <= batch_id][-2:]
    named = {f"{version}/year={year}" for b in kept for year, version in _read_manifest(spark, path, b).items()}
    for folder in files.globStatus(at("version=*")) or []:
        version = folder.getPath().getName()
        years = [s.getPath().getName() for s in files.globStatus(at(version, "year=*")) or []]
        if not any(f"{version}/{year}" in named for year in years):
            files.delete(folder.getPath(), True)
            continue
        for year in years:
            if f"{version}/{year}" not in named:
                files.delete(at(version, year), True)
    for b in _manifests(spark, path):
        if b < batch_id and b not in kept:
            files.delete(at("_manifest", f"{b:012d}.json"), False)


def replay_by_time(spark: SparkSession, sf_dir: str, path: str, late: str, pieces: int) -> Iterator[dict]:
    """Order lines land in order of time, piece after piece, and each is drained into the table at ``path``; yields each drain's progress.

    As on a live feed, a watermark of ``late`` frees the state of bars that are closed.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_shipdate").isNotNull()).select(*LINE_COLUMNS)
    source, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "bars-progress")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    first, last = lines.agg(F.min(day), F.max(day)).first()
    if first is None:
        return
    step = -(-(last + 1 - first) // pieces)
    for i in range(pieces):
        lines.filter((day >= first + i * step) & (day < first + (i + 1) * step)).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(lines.schema).option("recursiveFileLookup", True).parquet(source)
        ticks = line_ticks(stream).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        query = upsert_batches(line_bars(ticks, parts=_state_parts(spark)), path, checkpoint, spark)
        query.awaitTermination()
        yield query.lastProgress


def run_bars_replay(spark: SparkSession, sf_dir: str, late: str, pieces: int = 4) -> DataFrame:
    path = scratch_path(spark, "bars")
    for _ in replay_by_time(spark, sf_dir, path, late, pieces):
        pass
    return read_upserted(spark, path)


def run_bars_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the trades available now into the upserted bar table and read it."""
    path, checkpoint = scratch_path(spark, "bars"), scratch_path(spark, "bars-progress")
    upsert_batches(line_bars(ticks_stream(spark, sf_dir), parts=_state_parts(spark)), path, checkpoint, spark).awaitTermination()
    return read_upserted(spark, path)


def check_stream(bars: DataFrame) -> DataFrame:
    """The checks that look at one row only, unchanged on a stream."""
    broken = F.filter(F.array(F.when(bad_brackets(), "brackets"), F.when(not_positive(), "not positive"),
                              F.when(has_missing(), "missing")), lambda v: v.isNotNull())
    return bars.select("*", F.explode(broken).alias("violation"))


def run_checks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream trades as one-trade bars (a zero discount stands for a bad print) through the checks."""
    ticks = ticks_stream(spark, sf_dir)
    bad = F.col("discount_pct") == 0
    bars = ticks.select(
        F.col("ts").cast("date").alias("date"), ticker_of(F.col("l_suppkey")).alias("ticker"), F.col("price").alias("open"), F.col("price").alias("high"),
        F.when(bad, F.col("price") + 1).otherwise(F.col("price")).alias("low"), F.col("price").alias("close"),
        F.when(F.col("quantity") == 1, None).otherwise(F.col("price")).alias("adj_close"), F.col("quantity").alias("volume"))
    path, checkpoint = scratch_path(spark, "violations"), scratch_path(spark, "violations-progress")
    found = check_stream(bars)
    (found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(found.schema).parquet(path)
