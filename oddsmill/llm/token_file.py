"""Token ids in directly addressable codes, written in the order of doc_id and read back.

A block holds the ids of consecutive documents. Each id is split into chunks of 8 bits; level k has the k-th
chunk of every id that has one, a bitmap that says whether the id goes on, and a rank directory with the number
of set bits before each 512th position. The place of an id's next chunk is the rank of its bit, so any id is
read by a few look-ups and no block is decoded for it.

Blocks are rows of an uncompressed Parquet table in the shared folder: Spark's commit keeps them whole when executors are
lost, any store that Spark reads can hold them, and the bytes of a level stand in the file as they are. A directory with the
place of each block finds the block of any position.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, materialise, table
from oddsmill.llm._tokens import BATCH, encoder, texts_of

RANK_STEP = 512
_SET_BITS = np.array([x.bit_count() for x in range(256)], np.int64)
BLOCKS = "shard int, first long, doc_ids array<long>, doc_lens array<long>, n_ids long, levels array<struct<chunks:binary,more:binary,ranks:binary>>"


def encode_block(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of chunks, continuation bits and rank directory of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 0xFF
        sums = np.concatenate([[0], np.cumsum(goes_on, dtype=np.uint32)])
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": np.packbits(goes_on, bitorder="little").tobytes(), "ranks": sums[:-1:RANK_STEP].astype("<u4").tobytes()})
        if not goes_on.any():
            return levels
        rest = rest[goes_on] >> 8


class BlockReader:
    """Random access to the ids of a block."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, more, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not more[i >> 3] >> (i & 7) & 1:
                break
            start = i // RANK_STEP * RANK_STEP
            before = np.unpackbits(more[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start]
            i, shift = int(ranks[i // RANK_STEP]) + int(before.sum()), shift + 8
        return value

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at many positions, by the same look-ups."""
        out, own = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, more, ranks) in enumerate(self.levels):
            out[own] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            on = (more[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            own, at = own[on], at[on]
            if not len(at):
                break
            # The set bits of the position's stretch before it: whole bytes, then the bits of its own byte.
            first = at // RANK_STEP * (RANK_STEP // 8)
            place = first[:, None] + np.arange(RANK_STEP // 8)
            byte = more[np.minimum(place, len(more) - 1)] * (place < (at >> 3)[:, None])
            inside = _SET_BITS[byte].sum(1) + _SET_BITS[more[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = ranks[at // RANK_STEP].astype(np.int64) + inside
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(len(self), np.uint32)
        at = np.arange(len(self))
        for k, (chunks, more, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(more, bitorder="little")[: len(chunks)].astype(bool)]
        return out


def write_token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, ids_per_block: int = 1 << 18, bytes_per_range: int = 64_000_000) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text; other columns are ignored) and returns the written blocks.

    Rows are in ascending order of doc_id, nulls first, and of the text's hash for equal doc_ids; a null or
    empty text has its end id alone; repeated rows are all written. A block ends with the document that
    fills it, so a long document makes a long block. An empty table gives no blocks.
    """

    def run(batches):
        enc, shard, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lens, docs_, held = [], [], [], 0

        def flush():
            levels = encode_block(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([{"shard": shard, "first": first, "doc_ids": docs_, "doc_lens": lens, "n_ids": held, "levels": levels}], schema=arrow)

        for b in batches:
            for part in by_bytes(b, 1, BATCH):
                every, starts = enc.encode_with_end(texts_of(part.column(1)), end_id)
                for d, at, to in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    ids.append(every[at:to])
                    lens.append(to - at)
                    docs_.append(d)
                    held += to - at
                    if held >= ids_per_block:
                        yield flush()
                        first += held
                        ids, lens, docs_, held = [], [], [], 0
        if docs_:
            yield flush()

    level = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
    arrow = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("levels", pa.list_(level))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_range))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc())
    return materialise(ordered.mapInArrow(run, BLOCKS), "token-blocks", compression="none")


def with_places(blocks: DataFrame) -> DataFrame:
    """The blocks with ``start``, the number of ids before each: the directory of the file."""
    # One row for each shard, of which there are as many as ranges: small enough to sum up and broadcast.
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("first"))


def tokens_at(blocks: DataFrame, positions: DataFrame, span: int = 1 << 18) -> DataFrame:
    """position, token of each row of ``positions`` (position: ids of the whole file before it); places beyond the file have no row.

    Positions and blocks meet in stretches of ``span`` ids; a block is read by look-ups and not decoded.
    """
    last = F.col("start") + F.col("n_ids") - 1
    dealt = with_places(blocks).select("start", "n_ids", "levels", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(last / span))).alias("stretch"))
    asked = positions.select(F.col("position").cast("long").alias("position"), F.floor(F.col("position") / span).alias("stretch"))
    inside = asked.join(dealt.select("stretch", "start", "n_ids"), "stretch").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids")))
    own = inside.groupBy("stretch", "start").agg(F.collect_list("position").alias("positions"))  # those of a stretch and block

    def run(batches):
        for b in batches:
            for start, at, levels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(BlockReader(levels).take(np.array(at, np.int64) - start).astype(np.int64))], ["position", "token"])

    return own.join(dealt.select("stretch", "start", "levels"), ["stretch", "start"]).select("start", "positions", "levels").mapInArrow(run, "position long, token long")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Each document of the written blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = BlockReader(r["levels"]).all().astype("<u4").tobytes()
                lens = np.asarray(r["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                base = r["start"] + ends - lens
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(base), pa.array(lens), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_places(blocks).select("start", "doc_ids", "doc_lens", "levels")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
