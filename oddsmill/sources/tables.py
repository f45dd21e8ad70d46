"""Tables: scans, scratch tables that cut lineage, and partitioned sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session that driver and executors share, below ``spark.checkpoint.dir`` or, where that is unset, the
    warehouse. It is deleted when the driver ends. A warehouse on a machine's own disk won't do on a cluster, which is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = not re.match(r"[a-zA-Z][\w+.-]*:", shared) or shared.startswith("file:")
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {shared} is on each machine's own disk")
    found = f"{shared.rstrip('/')}/oddsmill-{spark.sparkContext.applicationId}"
    fs, path, new = ensure_dir(spark, found)
    if new:
        fs.deleteOnExit(path)
    return found


def ensure_dir(spark: SparkSession, folder: str):
    """Makes ``folder`` in any store that Spark reaches: its file system, its path and whether it is new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, path, not fs.exists(path) and fs.mkdirs(path)


_LISTS: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_lists", default=())


def scratch_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that executors may be lost without computing it again."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for paths in _LISTS.get():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def listed_scratch() -> Iterator[list[str]]:
    """The paths of the scratch tables that are written inside; ``discard`` deletes them where all that reads them has been written."""
    before, paths = _LISTS.get(), []
    token = _LISTS.set((*before, paths))
    try:
        yield paths
    finally:
        _LISTS.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task sorts or holds in windows; wide ones take some 600 bytes in memory, so a task needs some 200 MB.
ROWS_A_TASK = 300_000


def lanes(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: more of them where there is more data, so that the memory of a task stays the same and sorts don't spill."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


_BUILT: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def files_of(spark: SparkSession, *paths: str) -> tuple:
    """Name, size and time of change of each file of the given tables, which differ when their data do."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return tuple(out)


def built_once(spark: SparkSession, name: str, inputs: list[str], build) -> DataFrame:
    """The scratch table of ``build()`` over the tables ``inputs``, written at its first use in a session and read by all queries that name it
    after that, until a file of the inputs changes."""
    key, now = (spark.sparkContext.applicationId, name), files_of(spark, *inputs)
    if key not in _BUILT or _BUILT[key][0] != now:
        for old in [k for k in _BUILT if k[0] != key[0]]:  # of sessions that have ended
            del _BUILT[old]
        _BUILT[key] = (now, scratch_table(build(), "built"))
    return _BUILT[key][1]


def scan(spark: SparkSession, path: str, schema, platform: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with an explicit schema, one platform's rows and the columns asked for."""
    df = spark.read.schema(schema).parquet(path)
    if platform is not None:
        df = df.where(F.col("platform") == platform)
    return df.select(*columns) if columns else df


def chronological(trades: DataFrame) -> DataFrame:
    """Trades in the order in which they happened; ranges of time are sorted apart, so no task sorts all."""
    return trades.orderBy("ts", "tx_hash", "asset_id")


def replace_platform(df: DataFrame, path: str) -> None:
    """Swaps the partitions of the platforms in ``df``; those of others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("platform").parquet(path)
