"""Benchmark decontamination by the q-gram lemma.

A passage of a document within k edits of an item of m characters shares at least m - q + 1 - k*q of the
item's character q-grams with it, and the diagonals (place in the document less place in the item) of those differ by at
most k. So shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half; bands that reach the
bound are verified by an alignment whose cells keep to the band. Nothing within the edit budget is lost.

A q-gram that an item repeats often would meet itself at every pair of places. Such places are left out of the index, and
out of the item's bound; an item of which too little is left is aligned with the stretches of a document that
have as many of its q-grams, in any order, as the bound asks for.

Texts are compared in lower case with each run of white space as one space. A batch of documents stands in
one array of code points, with a zero between documents that no item contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, materialise, table

HITS = "doc_id long, item_id long, start long, end long, edits long"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_FOLD = np.arange(0x3000, dtype=np.uint32)
for _c in range(len(_FOLD)):
    if len(chr(_c).lower()) == 1:
        _FOLD[_c] = ord(chr(_c).lower())
    if chr(_c).isspace():
        _FOLD[_c] = 32


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points compared, and the place of each in ``text``."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(a < len(_FOLD), _FOLD[np.minimum(a, len(_FOLD) - 1)], a)
    blank = a == 32
    at = np.flatnonzero(~(blank & np.concatenate([[False], blank[:-1]])))
    return a[at], at


def qgrams(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each place."""
    if len(a) < q:
        return np.zeros(0, np.uint64)
    n = len(a) - q + 1
    powers = [_MIX]
    out, done, part, size = np.zeros(n, np.uint64), 0, a.astype(np.uint64), 1
    while True:  # by doubling: part has the hash of ``size`` code points
        if q & size:
            out = out * powers[-1] + part[done : done + n]
            done += size
        if size * 2 > q:
            return (out ^ (out >> np.uint64(29))) * _MIX
        part = part[:-size] * powers[-1] + part[size:]
        powers.append(np.uint64(int(powers[-1]) ** 2 & 0xFFFFFFFFFFFFFFFF))
        size *= 2


_FAR = 1 << 30


def align(item: np.ndarray, region: np.ndarray, lowest: int, highest: int, budget: int) -> tuple[int, int]:
    """Fewest edits between ``item`` and a passage of ``region``, and the end of the first such passage.

    Only cells whose diagonal (place in the region less place in the item) is ``lowest`` to ``highest`` are filled, a row of
    the item at a time, and none once a row is over the budget.
    """
    m, n = len(item), len(region)
    lowest, highest = max(lowest, -m), min(highest, n)
    if lowest > highest:
        return budget + 1, 0
    width = np.arange(highest - lowest + 1)
    row = np.where((width + lowest >= 0) & (width + lowest <= n), 0, _FAR)
    padded = np.concatenate([np.full(max(0, -lowest) + 1, 0xFFFFFFFF, np.uint32), region.astype(np.uint32), np.full(max(0, m + highest - n) + 1, 0xFFFFFFFF, np.uint32)])
    shift = max(0, -lowest)
    for i, c in enumerate(item.tolist(), 1):
        at = i + lowest  # the place of the first cell
        down = row + (padded[at + shift : at + shift + len(width)] != c)
        down[:-1] = np.minimum(down[:-1], row[1:] + 1)
        row = np.minimum.accumulate(down - width) + width
        if at < 0:
            row[: min(len(row), -at)] = _FAR
        if at + len(width) > n + 1:
            row[max(0, n + 1 - at) :] = _FAR
        if row.min() > budget:
            return budget + 1, 0
    end = int(row.argmin())
    return int(row[end]), m + lowest + end


def passage(item: np.ndarray, region: np.ndarray, lowest: int, highest: int, budget: int) -> tuple[int, int, int] | None:
    """start, end, edits of the passage of ``region`` that is nearest to ``item``, if it is within the budget."""
    edits, end = align(item, region, lowest, highest, budget)
    if edits > budget:
        return None
    m = len(item)
    _, back = align(item[::-1], region[:end][::-1], end - m - highest, end - m - lowest, budget)
    return end - back, end, edits


def passages(item: np.ndarray, region: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """Passages of ``region`` within the budget that don't overlap: the nearest, then those on either side of it."""
    found, todo = [], [(0, len(region))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= len(item) - budget and (p := passage(item, region[lo:hi], -len(item), hi - lo, budget)):
            found.append((lo + p[0], lo + p[1], p[2]))
            todo += [(lo, lo + p[0]), (lo + max(p[1], p[0] + 1), hi)]
    return found


@dataclass
class Items:
    """A bounded block of benchmark items, indexed by their q-grams."""

    ids: list[int]
    texts: list[np.ndarray]
    q: int
    budgets: np.ndarray
    bounds: np.ndarray  # of shared q-grams; 0: the item is shorter than a q-gram
    left: np.ndarray  # the same without places of often repeated q-grams; under 1: the item isn't indexed by place
    grams: np.ndarray  # distinct, with the entries of each from ``first`` on
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    repetitive: dict[int, np.ndarray]  # distinct q-grams of the items that aren't indexed by place

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], q: int, rate: float, often: int = 8) -> Items:
        pairs = [(i, fold(t.strip())[0]) for i, t in rows if t and t.strip()]
        ids, texts = [i for i, _ in pairs], [t for _, t in pairs]
        m = np.array([len(t) for t in texts], np.int64)
        budgets = np.minimum((m * rate).astype(np.int64), np.maximum(0, (m - q) // q))
        bounds = np.maximum(0, m - q + 1 - budgets * q)
        left, repetitive, kept = bounds.copy(), {}, []
        for k, t in enumerate(texts):
            g = qgrams(t, q)
            distinct, which, count = np.unique(g, return_inverse=True, return_counts=True)
            rare = count[which] <= often
            left[k] -= int((~rare).sum())
            if bounds[k] > 0 and left[k] < 1:
                repetitive[k] = distinct
                rare[:] = False
            at = np.flatnonzero(rare)
            kept.append((g[at], np.full(len(at), k), at))
        every, item, place = (np.concatenate([*[x[j] for x in kept], np.zeros(0, kind)]) for j, kind in enumerate((np.uint64, np.int64, np.int64)))
        by = np.argsort(every, kind="stable")
        every, item, place = every[by], item[by], place[by]
        distinct, first = np.unique(every, return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        for g in (distinct, *repetitive.values()):
            seen[g >> np.uint64(64 - _BITS)] = True
        return cls(ids, texts, q, budgets, bounds, left, distinct, np.append(first, len(every)), item, place, seen, repetitive)

    def _dense(self, at: np.ndarray, least: int, span: int) -> np.ndarray:
        """Which of the ascending places ``at`` lie in a span with ``least`` of them."""
        if len(at) < least:
            return np.zeros(len(at), bool)
        starts = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= span)
        marks = np.zeros(len(at) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + least, -1)
        return np.cumsum(marks[:-1]) > 0

    def candidates(self, at: np.ndarray, g: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int, int]]:
        """Item, first and last diagonal of each band that meets its item's bound, from the q-grams ``g`` at ``at``; about
        ``most`` pairs of places are held at once."""
        indexed = (self.bounds > 0) & (self.left >= 1)
        if not len(self.grams) or not indexed.any():
            return
        slot = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        same = self.grams[slot] == g
        at, slot = at[same], slot[same]
        # A band that meets its bound has as many hits in a span no longer than the longest item and its edits.
        span = int((np.array([len(t) for t in self.texts]) + 2 * self.budgets).max())
        some = self._dense(at, int(self.left[indexed].min()), span)
        at, slot = at[some], slot[some]
        n = self.first[slot + 1] - self.first[slot]
        sums = np.concatenate([[0], np.cumsum(n)])
        bits = max(1, max(len(t) for t in self.texts).bit_length())
        for share in range(shares := -(-2 * int(sums[-1]) // (4 * most)) or 1):  # the items are dealt out if there are that many pairs
            codes, lo = [np.zeros(0, np.int64)], 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + most, side="right")) - 1)
                own = n[lo:hi]
                pick = np.repeat(self.first[slot[lo:hi]] - (sums[lo:hi] - sums[lo]), own) + np.arange(sums[hi] - sums[lo])
                diagonal = np.repeat(at[lo:hi], own) - self.place[pick]
                if shares > 1:
                    mine = self.item[pick] % shares == share
                    pick, diagonal = pick[mine], diagonal[mine]
                item, place = self.item[pick], self.place[pick]
                band = diagonal // (self.budgets[item] + 1)
                for k in (0, 1):  # the band and the one before, which it overlaps
                    codes.append(np.unique(((band - k + (1 << 20)) * len(self.ids) + item) << bits | place))
                lo = hi
            # Distinct places of the item within a band.
            key, count = np.unique(np.unique(np.concatenate(codes)) >> bits, return_counts=True)
            for k in key[count >= self.left[key % len(self.ids)]].tolist():
                i, b = k % len(self.ids), k // len(self.ids) - (1 << 20)
                step = int(self.budgets[i]) + 1
                yield i, b * step, (b + 2) * step - 1

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text's number, item_id, start, end, edits), places in code points of the text, least edits first kept."""
        texts = [t or "" for t in texts]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        a, at = fold("\0".join(texts))
        low = np.searchsorted(at, starts)
        ends = np.append(low[1:-1] - 1, len(a)) if len(texts) > 1 else np.array([len(a)])
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

        def add(doc: int, i: int, lo: int, p: tuple[int, int, int]) -> None:
            found.setdefault((doc, i), []).append((int(at[lo + p[0]] - starts[doc]), int(at[lo + p[1] - 1] - starts[doc]) + 1, p[2]))

        def doc_at(place: int) -> int:
            return int(np.searchsorted(low, min(max(0, place), max(0, len(a) - 1)), side="right")) - 1

        g = qgrams(a, self.q)
        hits = np.flatnonzero(self.seen[g >> np.uint64(64 - _BITS)])
        g = g[hits]
        for i, first, last in self.candidates(hits, g):
            item, k = self.texts[i], int(self.budgets[i])
            for doc in range(doc_at(first), doc_at(last + len(item)) + 1):
                lo, hi = max(first - k, int(low[doc])), min(last + len(item) + k, int(ends[doc]))
                if hi - lo >= len(item) - k and (p := passage(item, a[lo:hi], first - k - lo, last + k - lo, k)):
                    add(doc, i, lo, p)
        for i, own in self.repetitive.items():
            item, k = self.texts[i], int(self.budgets[i])
            near = hits[own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g]
            near = near[self._dense(near, int(self.bounds[i]), len(item) + k)]
            for part in np.split(near, np.flatnonzero(np.diff(near) > len(item) + k) + 1) if len(near) else []:
                for doc in range(doc_at(int(part[0])), doc_at(int(part[-1])) + 1):
                    lo, hi = max(int(part[0]) - len(item) - k, int(low[doc])), min(int(part[-1]) + len(item) + k, int(ends[doc]))
                    for p in passages(item, a[lo:hi], k):
                        add(doc, i, lo, p)
        for i, item in enumerate(self.texts):
            if self.bounds[i] <= 0:  # too short for a q-gram: equal passages only
                needle, hay, p = item.astype("<u4").tobytes(), a.astype("<u4").tobytes(), -4
                while (p := hay.find(needle, p + 4)) >= 0:
                    if p % 4 == 0:
                        add(doc_at(p // 4), i, p // 4, (0, len(item), 0))
                    else:
                        p -= p % 4
        out = []
        for (doc, i), spans in sorted(found.items()):
            taken: list[tuple[int, int]] = []
            for s, e, edits in sorted(set(spans), key=lambda x: (x[2], x[0])):
                if all(e <= x or y <= s for x, y in taken):
                    taken.append((s, e))
                    out.append((doc, self.ids[i], s, e, edits))
        return out


def _blocks(benchmark: DataFrame, q: int, rate: float, max_chars: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``max_chars`` characters, of which the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // max_chars)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield Items.of(sorted(map(tuple, rows.where(key == k).collect()), key=lambda r: (r[0] is None, r)), q, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, max_chars: int = 4_000_000) -> DataFrame:
    """The passages of ``docs`` (doc_id, text) that are within ``rate`` edits a character of an item (item_id, text).

    Returns doc_id, item_id, start, end (code points, end exclusive) and edits of each; passages of the
    same item in a document don't overlap. An item gets as many edits as the bound can prove, none if it is
    shorter than two q-grams. Null and empty texts and items match nothing; repeated rows and items are each
    reported; empty tables give no rows; other columns are ignored.

    The benchmark is a stated set of queries: each block of it meets all rows, and what it finds is written before the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, q, rate, max_chars):

        def run(batches, items=items):
            for b in batches:
                for part in by_bytes(b, 1, 1_000_000):
                    ids = part.column(0).to_pylist()
                    hits = [(ids[d], *rest) for d, *rest in items.find(part.column(1).to_pylist())]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

        one = materialise(rows.mapInArrow(run, HITS), "leaks")
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, max_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of the benchmark (see ``leaks``).

    Null and empty texts hold none and stay; repeated rows stay or go alike; empty tables take nothing away.
    """
    where = docs.columns.index("text")
    kept = docs
    for k, items in enumerate(_blocks(benchmark, q, rate, max_chars)):

        def run(batches, items=items):
            for b in batches:
                for part in by_bytes(b, where, 1_000_000):
                    bad = {d for d, *_ in items.find(part.column(where).to_pylist())}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))

        kept = (materialise(kept, "clean") if k else kept).mapInArrow(run, docs.schema)
    return kept


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
