"""Raw bars to a clean and a screened table: the daily build."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from panelspark.operators import quality, repair, universe
from panelspark.schemas import BARS, ScreenConfig
from panelspark.sources import sinks


class Built(NamedTuple):
    clean: DataFrame
    screened: DataFrame | None
    checks: DataFrame
    repairs: repair.RepairResult
    backfilled: DataFrame | None


def build_panel(raw: DataFrame, clean_path: str, events: DataFrame | None = None, lists: DataFrame | None = None,
                screened_path: str | None = None, cfg: ScreenConfig = ScreenConfig(backfill=True)) -> Built:
    """Repair, write, check and screen.

    Each stage reads the table the one before it wrote, so nothing upstream runs
    twice and a failed stage restarts from the last table.
    """
    spark = raw.sparkSession
    repairs = repair.repair(raw, events)
    sinks.write_panel(repairs.panel, clean_path)
    clean = spark.read.schema(BARS).parquet(clean_path)
    checks = quality.validate(clean, seq=None)
    if lists is None or screened_path is None:
        return Built(clean, None, checks, repairs, None)
    screened = universe.screen(clean, cfg, lists)
    sinks.write_panel(screened, screened_path)
    stored = spark.read.schema(screened.schema).parquet(screened_path)
    return Built(clean, stored, checks, repairs, universe.backfilled_share(stored, lists))
