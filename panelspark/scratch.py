"""Intermediate tables in the shared checkpoint folder.

Lineage is cut by writing a Parquet table to the folder named in
``spark.checkpoint.dir``, never to executor-local storage, so a lost executor
costs a re-read and not a different answer.  A folder of our own is set only
when the setting is absent and the master is local, as in tests; what this
application wrote is removed when the interpreter ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Of a table's files; half a million to a million order lines, as they compress, whose rows a task sorts in at most 200 MB.
PARTITION_BYTES = 8 << 20
PARTITION_ROWS = 1 << 20  # of a stored table of a few numbers a row

_own_roots: dict[str, str] = {}
_stored: dict[tuple, str] = {}
_buckets: dict[str, int] = {}
_written: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _own_roots:
        root = _own_roots[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _own_roots[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/panelspark/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def table_state(spark: SparkSession, path: str) -> tuple:
    """What tells a stored table from a later one at the same place: files, bytes, and when it was changed."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = files.getContentSummary(where)
    return path, held.getFileCount(), held.getLength(), files.getFileStatus(where).getModificationTime()


def partitions_for(spark: SparkSession, path: str) -> int:
    """Partitions for work on the rows of a table: the session's number, or more where a task's share would outgrow its memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table_state(spark, path)[2] // PARTITION_BYTES))


def partitions_for_rows(spark: SparkSession, n: int) -> int:
    """The same for a known number of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PARTITION_ROWS))


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        remove(df._scratch_path)


def remove(path: str) -> None:
    """Delete one scratch table, wherever the checkpoint folder is."""
    spark = _written.pop(path, None)
    if spark is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove_all() -> None:
    """Delete every scratch table of this process; results that still read them can't be used after."""
    for path in list(_written):
        try:
            remove(path)
        except Exception:  # the session has ended: its folder is its owner's to clear
            _written.pop(path, None)


atexit.register(remove_all)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: later passes see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def stored_by_ticker(spark: SparkSession, key: tuple, build, buckets: int | None = None) -> DataFrame:
    """A panel kept as a table bucketed by ticker, built once per application.

    Per-ticker windows and ticker joins on it need no further exchange.  ``build``
    ends partitioned by ticker, so each task writes whole buckets.
    """
    full_key = (spark.sparkContext.applicationId, *key)
    for old in [k for k in _stored if k[:3] == full_key[:3] and k != full_key]:  # the same folder with other files in it
        spark.sql(f"DROP TABLE IF EXISTS {_stored.pop(old)}")
    name = _stored.get(full_key)
    if name is None or not spark.catalog.tableExists(name):
        name = f"panelspark_{key[0]}_{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        (build().write.bucketBy(buckets, "ticker").sortBy("ticker", "date")
         .option("path", scratch_path(spark, key[0]))
         .saveAsTable(name))
        _stored[full_key] = name
        _buckets[name] = buckets
    panel = spark.table(name)
    panel._ticker_buckets = _buckets[name]
    return panel


def forget_stored(spark: SparkSession) -> None:
    """Drop this application's stored panels from the catalog, so the next use builds them anew."""
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        spark.sql(f"DROP TABLE IF EXISTS {_stored.pop(key)}")
