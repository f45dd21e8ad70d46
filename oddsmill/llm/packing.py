"""Packing of documents into sequences of fixed length: first-fit decreasing in randomised groups.

Every document becomes its token ids and one end id. It is cut at multiples of the sequence length; a full
piece is a sequence of its own, and the remainders of a group of pieces are packed first-fit decreasing,
where a tournament tree over the free room of the bins finds the first bin that fits in O(log bins).

Groups are random and of about ``pieces_per_group`` pieces, whatever the keys are and however long documents are, so that no
key, source, group of copies or long document makes a large one, and groups are packed independently of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, table
from oddsmill.llm._tokens import BATCH, binaries, encoder, texts_of

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class FreeRoom:
    """Tournament tree: each inner node holds the largest free room of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it, and returns that bin's number."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        bin_ = k - self.leaves
        k //= 2
        while k:
            most = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == most:
                break
            tree[k] = most
            k //= 2
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Bin and offset of each size (at most ``room``); equal sizes are placed in their given order."""
    tree, filled = FreeRoom(len(sizes), room), {}
    placed = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_ = tree.place(sizes[i])
        placed[i] = (bin_, filled.get(bin_, 0))
        filled[bin_] = placed[i][1] + sizes[i]
    return placed


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """doc_id, row, start, ids (little-endian unsigned 32-bit integers) and doc_tokens of the pieces of each row, the end id included."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for part in by_bytes(b, 1, BATCH):
                ids, starts = enc.encode_with_end(texts_of(part.column(1)), end_id)
                size = np.diff(starts)
                n = -(-size // room)
                of = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * room
                cuts = np.append(starts[of] + start, starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), part.column(2).take(pa.array(of)), pa.array(start), binaries(ids, cuts).cast(pa.binary()), pa.array(size[of])],
                    ["doc_id", "row", "start", "ids", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, start long, ids binary, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, room: int = 1024, pieces_per_group: int = 1024, seed: int = 7) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; other columns are ignored) with their place in the packed sequences.

    Returns doc_id, start, length, ids (binary, 4 bytes an id), doc_tokens, sequence_id, offset. Each row of
    ``docs`` is packed, also a repeated one; a null or empty text has its end id alone; a null doc_id stays
    null; an empty table gives no rows. Texts of any length are cut. Pieces keep their ids on the way, so what
    is written is what was packed.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-(rows + size // room) // pieces_per_group))  # no text has more ids than bytes

    def pack(key, t):
        t = t.sort_by([("row", "ascending"), ("start", "ascending")])
        length = np.array([len(x) // 4 for x in t.column("ids").to_pylist()], np.int64)
        whole = length == room
        rest = np.flatnonzero(~whole)
        sequence, offset = np.cumsum(whole) - 1, np.zeros(len(length), np.int64)
        placed = first_fit_decreasing(length[rest].tolist(), room)
        sequence[rest] = int(whole.sum()) + np.array([b for b, _ in placed], np.int64)
        offset[rest] = [o for _, o in placed]
        cols = [t.column("doc_id"), t.column("start"), pa.array(length), t.column("ids"), t.column("doc_tokens"), pa.array(sequence + (key[0].as_py() << 32)), pa.array(offset)]
        return pa.table(cols, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    grouped = cut_pieces(docs, tokenizer, end_id, room).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))
    return grouped.groupBy("g").applyInArrow(pack, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The query's columns: the pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()))
