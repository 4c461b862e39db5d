"""A local session for tests and the benchmark.  On a cluster, use the session it gives you."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = 8, app: str = "panelspark") -> SparkSession:
    shared = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a panel bucketed by ticker is then joined on (ticker, date) where it lies; set it on a cluster too
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
