"""Tables whose parts are swapped atomically, and tables that are read page by page.

A versioned table has a folder of data for each write and a folder of numbered manifests, each the list of all parts (platform: folder) and their
schema. A write is staged beside the data that readers see; then the next manifest appears by a rename that fails if another writer was
first, in which case the swap is tried again upon that one's. Readers follow the manifest of the highest number, so they see the table before
or after a swap and nothing between, and go on with the files of the version they have read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsmill.sources.tables import ensure_dir

TRADE_ORDER = ("ts", "tx_hash", "asset_id", "wallet_address")


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path, _ = ensure_dir(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and n[0].isdigit()]


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/_manifests/{number:010d}.json", wholetext=True).head()[0])


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Whether version ``number`` is now ``content``; False if it exists."""
    jvm = spark._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    fs, folder, _ = ensure_dir(spark, f"{path}/_manifests")
    staged = to_path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(json.dumps(content).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    strict = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(staged, to_path(folder, f"{number:010d}.json"), strict)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(staged, False)
        return False
    return True


def stage(df: DataFrame, path: str) -> dict:
    """Writes ``df`` beside what readers see: a part for each platform in it."""
    name = f"data/{uuid.uuid4().hex}"
    df.write.partitionBy("platform").parquet(f"{path}/{name}")
    parts = {n.removeprefix("platform="): f"{name}/{n}" for n in _names(df.sparkSession, f"{path}/{name}") if n.startswith("platform=")}
    return {"parts": parts, "schema": df.drop("platform").schema.json()}


def switch(spark: SparkSession, path: str, staged: dict) -> int:
    """Makes staged parts visible in place of those of the same platforms; the number of the new version."""
    while True:
        last = max(versions(spark, path), default=0)
        parts = manifest(spark, path, last)["parts"] if last else {}
        if _publish(spark, path, last + 1, {**staged, "parts": {**parts, **staged["parts"]}}):
            return last + 1


def swap(df: DataFrame, path: str) -> int:
    """Replaces the parts of the platforms in ``df``; those of others stay. The number of the new version."""
    return switch(df.sparkSession, path, stage(df, path))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version, or version ``number``; a filter on platform reads its part alone."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version of {path}")
    of = manifest(spark, path, number or found[-1])
    schema = StructType.fromJson(json.loads(of["schema"]))
    out = None
    for platform, part in sorted(of["parts"].items()):
        one = spark.read.schema(schema).parquet(f"{path}/{part}").withColumn("platform", F.lit(platform))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema.add("platform", "string")) if out is None else out


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the manifests of all but the last ``keep`` versions, and the data that no manifest names any more; the folders that went.

    Readers of an older version must have ended, and no swap may be between its stage and its switch."""
    numbers = versions(spark, path)
    kept = {part.split("/")[1] for n in numbers[-keep:] for part in manifest(spark, path, n)["parts"].values()}
    fs, _, _ = ensure_dir(spark, path)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    for n in numbers[:-keep]:
        fs.delete(to_path(f"{path}/_manifests/{n:010d}.json"), False)
    gone = [n for n in _names(spark, f"{path}/data") if n not in kept]
    for n in gone:
        fs.delete(to_path(f"{path}/data/{n}"), True)
    return gone


def write_paged(df: DataFrame, path: str, files: int, key: Sequence[str] = TRADE_ORDER, most: int = 1_000_000) -> None:
    """Writes ``df`` in ``files`` ranges of ``key``, or as many more as ranges of ``most`` rows take, with a table of each file's range; parts of
    the key must not be null."""
    spark = df.sparkSession
    files = max(files, -(-df.count() // most))
    df.repartitionByRange(files, *key).sortWithinPartitions(*key).write.parquet(f"{path}/rows")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows").select(F.input_file_name().alias("file"), F.struct(*key).alias("key"))
    written.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).write.parquet(f"{path}/ranges")


def _cursor(df: DataFrame, after: Sequence, key: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, after, strict=True)])


def page(spark: SparkSession, path: str, after: Sequence | None, limit: int, key: Sequence[str] = TRADE_ORDER) -> DataFrame:
    """The first ``limit`` rows after the key ``after`` (None: from the start), in order. Only files that hold some of them are read and sorted."""
    ranges = spark.read.parquet(f"{path}/ranges")
    rows = spark.read.parquet(f"{path}/rows")
    if after is not None:
        ranges = ranges.where(F.col("hi") > _cursor(rows, after, key))
    files, sure = [], 0
    for r in ranges.orderBy("lo", "hi").select("file", "n", "lo").toLocalIterator():  # ends with the page
        if sure >= limit:
            break
        files.append(r["file"])
        sure += r["n"] if after is None or tuple(r["lo"]) > tuple(after) else 0
    if not files:
        return rows.limit(0)
    found = spark.read.schema(rows.schema).parquet(*files)
    if after is not None:
        found = found.where(F.struct(*key) > _cursor(rows, after, key))
    return found.orderBy(*key).limit(limit)
