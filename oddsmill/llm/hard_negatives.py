"""Hard negatives by threshold joins over a pruned inverted index.

Rows are dealt into blocks and anchors into groups by a hash, and a task meets one group and one block, so no label, vector or id can gather in
a task. In a block, dimensions go by falling energy and in chunks; a row's postings end with the chunk from which its remaining norm and those of
the anchors can't reach the threshold any more. Partial scores are accumulated over the postings, pairs are pruned as soon as partial score and
remaining norms (Cauchy-Schwarz) stay below the threshold, and what is left is completed by the dimensions that the index omits. A threshold
starts high and is lowered, for the anchors that need it, until their windows are full or everything within the window was seen.

One part of the blocks is searched first; the worst score that an anchor's full window then holds is the threshold of its search of all
other blocks, so these give only what can still enter a window. Scores are exact integers.

Rows without label or vector, or with a component that is null or not finite, take no part. Vectors may differ in length: missing components
count as 0. Rows that repeat in id, label and quantised vector are one row; rows that share an id and differ otherwise are rows of their own.
A row without id is no anchor and comes after others of its score. Components and the scores of a search saturate at 64 bits.
An anchor without others of its label has no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import give_back, materialise, table

CHUNK = 8
STEPS = (1 / 4, 3 / 8, 7 / 16, 1 / 2, 1)
_MOST = (1 << 63) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q (integers), key: the rows that take part, each once."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    kept = kept.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = kept.select("vec_id", label.alias("label"), F.transform("v", lambda x: F.floor(x * 256)).alias("q")).dropDuplicates(["vec_id", "label", "q"])
    return rows.withColumn("key", F.xxhash64("vec_id", "label", "q"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of any length as rows of floats, or of Python's integers where floats could not hold all their products."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    top = max(abs(int(flat.min())), abs(int(flat.max()))) if len(flat) else 0
    out = np.zeros((len(size), width), np.float64 if top * top * max(1, width) < 1 << 52 else object)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat if out.dtype == np.float64 else [int(x) for x in flat]
    return out


def _tails(x: np.ndarray) -> np.ndarray:
    """The norm of each row from each chunk on; 0 after the last."""
    squares = x.astype(np.float64) ** 2
    by_chunk = np.add.reduceat(squares, np.arange(0, x.shape[1], CHUNK), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    return np.sqrt(np.concatenate([by_chunk[:, ::-1].cumsum(1)[:, ::-1], np.zeros((len(x), 1))], 1))


class Block:
    """Rows of a block, by label, with dimensions by falling energy."""

    def __init__(self, x: np.ndarray, ids: list, labels: np.ndarray, keys: np.ndarray):
        by = np.argsort(labels, kind="stable")
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x, self.labels, self.keys = x[by][:, self.order], labels[by], keys[by]
        self.null = np.array([i is None for i in ids], bool)[by]
        self.ids = np.array([i or 0 for i in ids], np.int64)[by]
        self.tail = _tails(self.x)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def reach(self, rows: slice, q: np.ndarray, tail: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row of the slice) whose score is ``least`` of the anchor or more, and their scores."""
        x, own = self.x[rows], self.tail[rows]
        chunks = own.shape[1] - 1
        slack = 1e-6 + 1e-9 * tail[:, :1].max(initial=0.0) * own[:, 0].max(initial=0.0)
        posted = (own[:, :-1] * tail[:, :-1].max(0, initial=0.0) >= least.min() - slack).sum(1)  # norms fall, so these are the first chunks
        live = np.arange(len(x)) if least.min() <= slack else np.flatnonzero(posted)
        acc = np.zeros((len(q), len(live)), np.result_type(q, x) if x.dtype == q.dtype else object)
        need = least[:, None] - slack
        for indexed in (True, False):  # postings first, then what the index omits, for the pairs that are left
            for c in range(chunks):
                some = (posted[live] > c) == indexed
                if not some.any():
                    continue
                part = q[:, c * CHUNK : (c + 1) * CHUNK] @ x[live[some], c * CHUNK : (c + 1) * CHUNK].T
                if some.all():
                    acc += part
                else:
                    acc[:, some] += part
                done = np.minimum(posted[live], c + 1) if indexed else np.maximum(posted[live], c + 1)
                keep = (acc.astype(np.float64) + tail[:, done] * own[live, done] >= need).any(0)
                if keep.sum() < 0.75 * len(live):
                    live, acc = live[keep], acc[:, keep]
        found = np.nonzero(acc >= least[:, None])
        return found[0], live[found[1]], acc[found]

    def windows(self, q: np.ndarray, ids: list, keys: np.ndarray, labels: np.ndarray, windows: list[list[tuple[float, float]]], k: int, same: bool):
        """For each anchor and each of its windows (lowest and highest score) the first ``k`` rows of its own label (``same``) or of others:
        anchor, window, row, score."""
        q = q[:, self.order]
        tail = _tails(q)
        for label in np.unique(labels).tolist() if same else [None]:
            rows = self.of_label(label) if same else slice(0, len(self.x))
            mine = np.flatnonzero(labels == label) if same else np.arange(len(q))
            for at in range(0, len(mine), 64):
                yield from self._batch(mine[at : at + 64], rows, q, tail, ids, keys, labels, windows, k, same)

    def _batch(self, todo, rows, q, tail, ids, keys, labels, windows, k, same):
        longest = self.tail[rows, 0].max(initial=0.0)
        top = {a: min(max(h for _, h in windows[a]), tail[a, 0] * longest + 1) for a in todo.tolist() if windows[a]}
        low = {a: max(min(w for w, _ in windows[a]), -tail[a, 0] * longest - 1) for a in top}
        todo = np.array(sorted(top), np.int64)
        for step in STEPS:
            if not len(todo):
                return
            least = np.array([low[a] if step == 1 else top[a] - (top[a] - low[a]) * step for a in todo.tolist()])
            one, row, score = self.reach(rows, q[todo], tail[todo], least)
            row = row + rows.start
            some = (self.labels[row] == labels[todo[one]]) == same
            if same:
                a = todo[one]
                some &= (self.keys[row] != keys[a]) | self.null[row] | (self.ids[row] != np.array([i or 0 for i in ids], np.int64)[a])
            one, row, score = one[some], row[some], score[some]
            by = np.lexsort((self.ids[row], self.null[row], -score, one))
            one, row, score = one[by], row[by], score[by]
            open_ = []
            for j, a in enumerate(todo.tolist()):
                start, stop = np.searchsorted(one, [j, j + 1])
                s, first = score[start:stop], []
                for lo, hi in windows[a]:
                    first.append(start + np.flatnonzero((s >= lo) & (s <= hi))[:k])
                if least[j] > low[a] and any(len(f) < k for f in first):
                    open_.append(a)
                else:
                    yield from ((a, w, row[i], score[i]) for w, f in enumerate(first) for i in f.tolist())
            todo = np.array(open_, np.int64)


def _within(positive: list[int], percents: tuple[int, int], floors: list[int | None]) -> list[tuple[float, float]]:
    """The window of each positive's score, from its floor on where one is known."""
    lo, hi = percents
    return [(-(-lo * p // 100) if f is None else f, hi * p // 100) for p, f in zip(positive, floors, strict=True)]


FOUND = {"anchor_key": pa.int64(), "anchor_id": pa.int64(), "window": pa.int32(), "row_id": pa.int64(), "row_key": pa.int64(), "score": pa.int64()}


def _search(rows: DataFrame, anchors: DataFrame, groups: int, k: int, percents: tuple[int, int] | None) -> DataFrame:
    """anchor_key, anchor_id, window, row_id, row_key, score: each block's first ``k`` rows for each window of each anchor.

    ``anchors`` has key, vec_id, label, q, group, and floor, the least score that can still enter (null: any); with ``percents`` it has
    positives, an array of (score, floor), and windows are theirs. Without, rows of the anchor's own label are taken.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            right = right.rename_columns([c.removeprefix("a_") for c in right.column_names])
            width = max([1, *(len(v) for t in (left, right) for v in t.column("q"))])
            block = Block(_matrix(left.column("q"), width), left.column("vec_id").to_pylist(), left.column("label").to_numpy(), left.column("key").to_numpy())
            q, ids, keys, labels = _matrix(right.column("q"), width), right.column("vec_id").to_pylist(), right.column("key").to_numpy(), right.column("label").to_numpy()
            if percents:
                windows = [_within([w["score"] for w in p], percents, [w["floor"] for w in p]) for p in right.column("positives").to_pylist()]
                windows = [[(lo, hi) if lo <= hi else (1, 0) for lo, hi in of] for of in windows]
            else:
                windows = [[(float("-inf") if f is None else f, float("inf"))] for f in right.column("floor").to_pylist()]
            found = [(int(keys[a]), ids[a], w, None if block.null[r] else int(block.ids[r]), int(block.keys[r]), max(-_MOST - 1, min(_MOST, int(s)))) for a, w, r, s in block.windows(q, ids, keys, labels, windows, k, not percents)]
        give_back()
        return pa.table([pa.array([x[n] for x in found], kind) for n, kind in enumerate(FOUND.values())], list(FOUND))

    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    left = rows.select("vec_id", "label", "q", "key", "block", every)
    right = anchors.withColumn("block", F.explode("blocks")).drop("blocks")
    right = right.select(*(F.col(c).alias(f"a_{c}") for c in right.columns))  # the same rows stand on both sides
    types = {pa.int64(): "long", pa.int32(): "int"}
    return left.groupBy("group", "block").cogroup(right.groupBy("a_group", "a_block")).applyInArrow(run, ", ".join(f"{c} {types[kind]}" for c, kind in FOUND.items()))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each anchor (and window) with their rank: blocks gave ``k`` each at most."""
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("row_id").isNull().alias("none"), "row_id", "row_key", "score")
    lists = found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("first"))
    return lists.select(*by, F.posexplode("first").alias("rank", "x")).select(*by, (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.row_id").alias("row_id"), F.col("x.row_key").alias("row_key"), F.col("x.score").alias("score"))


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, percents: tuple[int, int] = (30, 90), block_rows: int = 16_384, group_anchors: int = 16_384, least_rows: int = 1024
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; a positive's window holds the scores between ``percents`` of its own. A task meets about
    ``block_rows`` rows (fewer while there are tasks to spare, ``least_rows`` at least) and ``group_anchors`` anchors.
    """
    spark = embeddings.sparkSession
    rows = materialise(quantised(embeddings), "negatives-rows")
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).head()
    blocks = max(1, -(-n // block_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // least_rows))
    groups = max(1, -(-n_anchors // group_anchors))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int"))
    anchors = rows.where(F.col("vec_id") % every == 0).drop("block").withColumn("group", F.pmod(F.xxhash64("key", F.lit("group")), F.lit(groups)).cast("int"))
    head = -(-blocks // 16)
    parts = [(rows.where(F.col("block") < head), range(head)), (rows.where(F.col("block") >= head), range(head, blocks))]
    by, of = ["anchor_key", "anchor_id"], (F.col("key") == F.col("anchor_key")) & (F.col("vec_id") == F.col("anchor_id"))

    def asked(on: DataFrame, to: range) -> DataFrame:
        return on.withColumn("blocks", F.sequence(F.lit(to.start), F.lit(to.stop - 1)))

    near = materialise(_search(parts[0][0], asked(anchors.withColumn("floor", F.lit(None).cast("long")), parts[0][1]), groups, positives, None), "negatives-positives")
    if len(parts[1][1]):
        full = near.groupBy(*by).agg(F.array_sort(F.collect_list(-F.col("score").cast("decimal(20,0)"))).alias("s")).where(F.size("s") >= positives).select(*by, (-F.element_at("s", positives)).cast("long").alias("floor"))
        floors = anchors.join(full, of, "left").drop(*by)
        near = near.unionByName(materialise(_search(parts[1][0], asked(floors, parts[1][1]), groups, positives, None), "negatives-positives"))
    chosen = materialise(_first(near, by, positives), "negatives-chosen")

    def windows(floor) -> DataFrame:
        lists = floor.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "floor"))).alias("positives"))
        return anchors.join(lists, of).drop(*by)

    free = chosen.withColumn("floor", F.lit(None).cast("long"))
    hard = materialise(_search(parts[0][0], asked(windows(free), parts[0][1]), groups, negatives, percents), "negatives-found")
    if len(parts[1][1]):
        worst = F.array_sort(F.collect_list(-F.col("score").cast("decimal(20,0)")))
        full = hard.groupBy(*by, "window").agg(worst.alias("s")).where(F.size("s") >= negatives).select(*by, (F.col("window") + 1).alias("rank"), (-F.element_at("s", negatives)).cast("long").alias("floor"))
        floors = chosen.join(full, [*by, "rank"], "left")
        hard = hard.unionByName(materialise(_search(parts[1][0], asked(windows(floors), parts[1][1]), groups, negatives, percents), "negatives-found"))
    ranked = _first(hard, [*by, "window"], negatives).select(*by, (F.col("window") + 1).alias("of"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = chosen.select(*by, F.col("rank").alias("of"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return positive.join(ranked, [*by, "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and (a.vec_id <> b.vec_id or a.label <> b.label or a.q <> b.q)
),
positives as (select anchor_id, other_id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
