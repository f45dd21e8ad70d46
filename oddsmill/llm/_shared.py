"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.sources.tables import scratch_table

#: White space of every word contract: \x20 and \x09-\x0D, which is also what bytes.split() takes.
WS_BYTES = b" \t\n\x0b\x0c\r"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back, which cuts the lineage."""
    return scratch_table(df, name, compression)


def give_back() -> None:
    """Returns what this Python worker has freed to the system: workers live on from stage to stage beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def by_bytes(batch: pa.RecordBatch, text: int, most: int = 2_000_000, most_rows: int = 4096):
    """Slices of ``batch`` whose texts (column number ``text``) have about ``most`` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        if k > at and (size + n > most or k - at >= most_rows):
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, n: int):
    """crc32 of the value as text, modulo ``n``; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
