"""Near duplicates by min-max hashing.

Each of ``permutations`` hash functions gives two values of a shingle set, its smallest and its largest, so half the evaluations give a
signature of as many values as min-hashing, with less variance as the two are drawn without replacement. Signatures are cut into bands (those of
minima and those of maxima apart, so that a band's values come from different permutations); sets that share a band share a bucket. With 160
values in 32 bands of 5, two sets of similarity 0.85 share none with a probability below 1e-8, which is the only way to lose a link.

Buckets find links in two steps, and no step gives out the pairs of a bucket. Each set is compared with the smallest set of each of its buckets
(its stars, in lanes of bounded size); these links join nearly all of a group of copies. Only buckets whose sets are still in more than
one component are then joined exactly as regions (bounded in a task, cut by pivots beyond that), one for all buckets with the same sets.
Links are confirmed on the full sets, by 64-bit hashes of shingles; equal sets, told apart by 128 bits, are one node.

A null text, or one without words, has an empty set, is kept and is its own component. Rows of one doc_id are judged apart; of rows that share
a doc_id all with the smallest id of their component are kept, and a null doc_id is kept only where its component has no other. Each of repeated rows is
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, materialise, table
from oddsmill.llm.jaccard_join import Nodes, _links, _mix, _signatures, _texts, connected_components, shingle_sets


class MinMax:
    """Signatures of shingle sets: the smallest and largest value of each set under each of ``permutations`` hash functions."""

    def __init__(self, permutations: int = 80, rows: int = 5):
        seeds = _mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.xor, self.times, self.rows = seeds[:permutations], seeds[permutations:] | np.uint64(1), rows
        self.bands = 2 * (permutations // rows)

    def values(self, h: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """A row for each set (they start at ``opens``, none is empty): minima, then maxima."""
        out = np.empty((len(opens), 2 * len(self.xor)), np.uint64)
        x = np.empty_like(h)
        for k, (a, b) in enumerate(zip(self.xor, self.times, strict=True)):
            np.bitwise_xor(h, a, out=x)
            np.multiply(x, b, out=x)
            out[:, k] = np.minimum.reduceat(x, opens)
            out[:, len(self.xor) + k] = np.maximum.reduceat(x, opens)
        return out

    def band_hashes(self, values: np.ndarray) -> np.ndarray:
        """A hash for each band of each set; the number of the band is part of it."""
        half = values.shape[1] // 2
        out = np.empty((len(values), self.bands), np.uint64)
        for band in range(self.bands):
            side, k = divmod(band, self.bands // 2)
            x = np.full(len(values), band + 1, np.uint64)
            for j in range(k * self.rows, (k + 1) * self.rows):
                x = _mix(x * np.uint64(0xC2B2AE3D27D4EB4F) ^ values[:, side * half + j])
            out[:, band] = x
        return out


def _signed(docs: DataFrame, words: int, hashing: MinMax) -> DataFrame:
    """doc_id, th, n, a, b of each row, with the bands of its set unless this task gave them before."""
    kind = pa.list_(pa.int64())

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in by_bytes(batch, 2):
                h, at = shingle_sets(_texts(part.column(2)), words)
                a, b = _signatures(h, at)
                size = np.diff(at)
                new = [k for k, s in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if size[k] and s not in seen and not seen.add(s)]
                if len(seen) > 1_000_000:
                    seen = set()
                bands = [None] * part.num_rows
                if new:
                    keep = np.zeros(len(size), bool)
                    keep[new] = True
                    opens = np.cumsum(size[new]) - size[new]
                    for k, own in zip(new, hashing.band_hashes(hashing.values(h[np.repeat(keep, size)], opens)).view(np.int64).tolist(), strict=True):
                        bands[k] = own
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(a), pa.array(b), pa.array(bands, kind)], ["doc_id", "th", "n", "a", "b", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, a long, b long, bands array<long>")


def _full_sets(docs: DataFrame, every: DataFrame, wanted: DataFrame, words: int, nodes: Nodes, most: int) -> DataFrame:
    """node, n, shingles of the ``wanted`` nodes, each from one row that has the set."""
    holder = every.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("x")).select(F.col("node").alias("want"), F.col("x.th").alias("t"), F.col("x.doc_id").alias("d"))
    holder = materialise(holder, "dedup-holders")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 1):
                h, at = shingle_sets(_texts(part.column(1)), words)
                want = part.column(0).to_numpy()
                keep = np.flatnonzero(nodes.of(*_signatures(h, at)) == want).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(want[keep]), pa.array(np.diff(at)[keep]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], ["node", "n", "shingles"])

    if holder.count() <= most:  # 24 bytes a row
        holder = F.broadcast(holder)
    texts = docs.join(holder, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("want", "text")
    return materialise(texts.mapInArrow(run, "node long, n long, shingles binary").dropDuplicates(["node"]), "dedup-sets")


def _star_links(stars: DataFrame, sets: DataFrame, percent: int, lane_nodes: int) -> DataFrame:
    """a, b: the links among stars (pivot, node), confirmed on full sets."""
    lanes = stars.groupBy("pivot").agg(F.ceil(F.count("*") / lane_nodes).cast("int").alias("lanes"))
    dealt = stars.join(lanes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int").alias("lane"), "node")
    first = lanes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("pivot").alias("node"))
    rows = dealt.unionByName(first).join(sets.select("node", "shingles"), "node").select("pivot", "lane", (F.col("node") != F.col("pivot")).alias("other"), "node", "shingles")

    def run(batches):
        of = pivot = None
        for batch in batches:
            a, b = [], []
            for p, lane, other, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, np.uint64)
                if not other:
                    of, pivot = (p, lane), x
                elif of == (p, lane):
                    at = np.searchsorted(pivot, x)
                    at[at == len(pivot)] = 0
                    shared = int((pivot[at] == x).sum())
                    if 100 * shared >= percent * (len(x) + len(pivot) - shared):
                        a.append(p)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("pivot", "lane").sortWithinPartitions("pivot", "lane", "other").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 85, permutations: int = 80, rows: int = 5, lane_nodes: int = 1024, most: int = 1_000_000, leaf: int = 256, max_nodes: int = 4096, max_shingles: int = 4_000_000
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Rows link when their sets of ``words``-word shingles have a Jaccard similarity of at least ``percent`` per cent; component_id is the smallest
    doc_id that links reach, and the row that has it is kept. ``lane_nodes`` bounds how many sets a task compares with one pivot in one
    lane, ``max_nodes`` and ``max_shingles`` what a task joins as a region; ``most`` bounds a broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    first = materialise(_signed(texts, words, MinMax(permutations, rows)), "dedup-signatures")
    every = first.select("doc_id", "th", "n", "a", "b", "bands")
    clashes = first.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("a")
    clashes = first.join(clashes, "a").select("a", "b").distinct().collect()  # sets that share 64 bits of their hash: none below billions of sets
    nodes = Nodes([tuple(r) for r in clashes])
    if nodes.other:
        renamed = spark.createDataFrame([(a, b, node) for a, of in nodes.other.items() for b, node in of.items()], "a long, b long, node long")
        every = every.join(F.broadcast(renamed), ["a", "b"], "left").withColumn("node", F.coalesce("node", "a"))
    else:
        every = every.withColumn("node", F.col("a"))

    postings = every.where("bands is not null").select("node", "n", F.explode("bands").alias("h"))
    heads = postings.groupBy("h").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("last")).where("pivot.node <> last").select("h", "pivot")
    shared = materialise(postings.join(heads, "h").groupBy("h", "node").agg(F.first("n").alias("n"), F.first("pivot").alias("pivot")), "dedup-buckets")
    close = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    stars = materialise(shared.where(close & (F.col("node") != F.col("pivot.node"))).select(F.col("pivot.node").alias("pivot"), "node").distinct(), "dedup-stars")
    sets = _full_sets(texts, every, shared.select("node").distinct(), words, nodes, most)
    links = materialise(_star_links(stars, sets, percent, lane_nodes), "dedup-links")

    components = connected_components(links)
    labelled = shared.join(components, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    parted = labelled.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("of"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi and m > 2")
    regions = shared.select("h", "node").join(parted.groupBy("m", "of").agg(F.min("h").alias("h")), "h")  # one bucket of those with the same sets
    regions = materialise(regions.select(F.col("h").alias("region"), "node"), "dedup-regions")
    if not regions.isEmpty():
        links = links.unionByName(_links(regions, sets, percent, leaf, max_nodes, max_shingles))
        components = connected_components(links)

    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    smallest = every.where("n > 0").groupBy("node").agg(F.min(best).alias("best")).join(components.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    labels = smallest.groupBy("c").agg(F.min("best").alias("best"))
    by_set = smallest.select("node", "c").join(labels, "c").select("node", F.col("best.doc_id").alias("component_id"))
    out = every.join(by_set, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
