"""Exact Jaccard self-join of documents' shingle sets by pivots, and the components of its links.

Equal sets count as one node. With Jaccard distances nearly all nodes are at distance 1 from any pivot, so pivots alone
would put every node into the window of every region. Signatures find the pivots that matter: the hash range of the
shingles is cut into T = 2k parts, where k is the most shingles in which two linked sets of a size class may differ; at least T - k
parts are then equal in both, so they share one of the first k + 1 of their parts in a common order. The pivot of
a signature is the smallest node that has it, and the pivot's Voronoi region holds all nodes that share
a signature with it. Two nodes that link share a signature, hence a region.

Most nodes share a signature by chance, and ever more of them in a larger table. Before sets are sent, nodes are compared by the parities of the
numbers of shingles in as many slots as a set has shingles: two sets differ in at least as many shingles as parities. What is left of a region are
the groups of nodes that such bounds don't part; a group found in several regions is joined once.

A region is joined recursively as a metric space: each node goes to the nearest of several new pivots and, by the triangle
inequality, also to those within 2e of that distance (e: the distance of a link), until regions are small or are one
component; a region of bounded size is joined within one task. A region whose nodes are too alike in
distance for windows to part them is compared block by block. Components are those of all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm._shared import WS_BYTES, by_bytes, give_back, materialise, table
from oddsmill.sources.tables import discard, listed_scratch

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[list(WS_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, lower-cased (A-Z), of all texts in one array, and the number of words of each text."""
    raw = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b" " * 8]), np.uint8)]
    space = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    opens, size = turns[::2], turns[1::2] - turns[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from each position
    h = _mix((eight[opens] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _P))
    done, longer = 8, np.flatnonzero((size > 8) & (size <= 256))
    while len(longer):
        more = eight[opens[longer] + done] & _FIRST_BYTES[np.minimum(size[longer] - done, 8)]
        h[longer] = _mix(h[longer] * _Q ^ more)
        done += 8
        longer = longer[size[longer] > done]
    for k in np.flatnonzero(size > 256).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[opens[k] : opens[k] + size[k]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(opens, ends + 1), prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text, in order: all of them in one array, and where each starts.

    Words are lower-cased (A-Z). A text with fewer than ``words`` words has one shingle of all its words.
    """
    word, count = _word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = word.copy()
    for k in range(1, words):
        h *= _Q
        h[: max(0, len(h) - k)] += word[k:]  # only positions with all their words are used below
    h = _mix(h)
    sets, first = [], 0
    for c in count.tolist():
        if c >= words:
            x = np.sort(h[first : first + c - words + 1])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            sets.append(x[new])
        elif c:
            part = np.array([c], np.uint64)
            for k in range(first, first + c):
                part = part * _P + word[k]
            sets.append(_mix(part))
        else:
            sets.append(h[:0])
        first += c
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def _signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of 128 bits, in two halves, of each set that ``shingle_sets`` gives; 0 for an empty one."""
    out, size = [np.zeros(len(at) - 1, np.uint64) for _ in range(2)], np.diff(at)
    some = np.flatnonzero(size)
    if len(some):
        opens = at[some]
        squares, plain = np.add.reduceat(h * (h | np.uint64(1)), opens), np.add.reduceat(h, opens)
        mixed = np.add.reduceat(_mix(h ^ _Q), opens)
        n = size[some].astype(np.uint64)
        out[0][some] = _mix(squares + n * _P) ^ (_mix(plain * _Q) * _P)
        out[1][some] = _mix(mixed + n * _Q)
    return out[0].view(np.int64), out[1].view(np.int64)


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Nodes:
    """Numbers of the distinct sets: the first half of a set's hash, another number where two sets share that half."""

    def __init__(self, clashes: list[tuple[int, int]]):
        self.other: dict[int, dict[int, int]] = {}
        for a, b in sorted(clashes):
            others = self.other.setdefault(a, {})
            others[b] = xxhash.xxh3_64_intdigest(f"{a}:{b}") - (1 << 63) if others else a

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.other:
            a = np.array([self.other[x].get(y, x) if x in self.other else x for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        return a


class SizeClasses:
    """For each class of set sizes, how many shingles linked sets differ in at most, and into how many parts sets are cut.

    A set has signatures for its own class, and for the class below if a set of that class can link to it.
    """

    def __init__(self, percent: int, growth: float = 1.6, largest: int = 1 << 31):
        self.percent, lows, growth = percent, [1], max(growth, 100 / percent)  # sets of classes further apart don't link
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * growth)))
        self.lows = np.array(lows, np.int64)
        self.differ = np.array([self._differ(2 * a, b - 1 + (b - 1) * 100 // percent) for a, b in zip(lows, lows[1:], strict=False)] + [0], np.int64)
        self.parts = 2 * self.differ

    def _differ(self, least: int, most: int) -> int:
        """The most shingles in which two linked sets differ whose sizes add up to ``least`` to ``most``."""
        p = self.percent
        return max(q - 2 * (-(-p * q // (100 + p))) for q in range(max(least, most - 100 - p), most + 1))

    def signatures(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of all parts with shingles: the hash, the number of shingles, the set and how many first ones that set gives.

        Signatures of one set for two classes count as those of two sets: the set's number is doubled, plus one for the lower class.
        """
        size = np.diff(at)
        own = np.searchsorted(self.lows, size, side="right") - 1
        owner = np.repeat(np.arange(len(size)), size)
        found = []
        for below in (0, 1):
            c = own - below
            some = (size > 0) & (c >= 0) & (self.differ[np.maximum(c, 0)] > 0)
            if below:
                some &= (self.lows[own] - 1) * 100 >= self.percent * size
            e, o = h[some[owner]], owner[some[owner]]
            if not len(e):
                continue
            # Sets are in order, so the parts of one are runs.
            part = ((e >> np.uint64(32)) * self.parts[c[o]].astype(np.uint64)) >> np.uint64(32)
            opens = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (part[1:] != part[:-1])]))
            n = np.diff(np.append(opens, len(e)))
            of = o[opens]
            sums = np.add.reduceat(_mix(e + _P), opens)
            found.append((_mix(sums + part[opens] * _P + c[of].astype(np.uint64) * _Q), n, 2 * of + below, self.differ[c[of]] + 1))
        if not found:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def first(self, h: np.ndarray, at: np.ndarray, hot_h: np.ndarray, hot_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first signatures of each set in the common order, and their sets: rare before frequent, then those of many
        shingles, which sets share by chance least."""
        sig, n, of, wanted = self.signatures(h, at)
        often = np.zeros(len(sig), np.int64)
        if len(hot_h):
            slot = np.minimum(np.searchsorted(hot_h, sig), len(hot_h) - 1)
            often = np.where(hot_h[slot] == sig, hot_n[slot], 0)
        by = np.lexsort((sig, -n, often, of))
        sig, of, wanted = sig[by], of[by], wanted[by]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < wanted
        # A set with fewer parts than it needs has empty ones among its first, which stand for each other.
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.zeros(0, np.int64)
        short = last[place[last] + 1 < wanted[last]]
        return np.concatenate([sig[keep], _mix(wanted[short].astype(np.uint64) * _P)]), np.concatenate([of[keep], of[short]]) // 2


SETS = "doc_id long, th long, n long, a long, b long, hot array<struct<h:long,n:long>>"


def _sets(docs: DataFrame, words: int, classes: SizeClasses, local_hot: int) -> DataFrame:
    """A row for each document, and rows with the signatures that are frequent among some documents of a task."""
    chunk = 2_000_000
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
    names = ["doc_id", "th", "n", "a", "b", "hot"]

    def run(batches):
        held, size = [], 0

        def frequent():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= local_hot
            hot = [{"h": a, "n": b} for a, b in zip(h[some].view(np.int64).tolist(), n[some].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.array([hot], kind)], names)

        for batch in batches:
            for part in by_bytes(batch, 2):
                h, at = shingle_sets(_texts(part.column(2)), words)
                a, b = _signatures(h, at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at), pa.int64()), pa.array(a), pa.array(b), pa.nulls(part.num_rows, kind)], names)
                held.append(classes.signatures(h, at)[0])
                size += len(held[-1])
                if size >= chunk:
                    yield frequent()
                    held, size = [], 0
        if size:
            yield frequent()

    return docs.mapInArrow(run, SETS)


def _postings(docs: DataFrame, words: int, classes: SizeClasses, nodes: Nodes, hot_h: np.ndarray, hot_n: np.ndarray) -> DataFrame:
    """h, node for each of a set's first signatures."""

    def run(batches):
        seen: set[int] = set()  # sets already given by this task; a copy adds nothing
        for batch in batches:
            for part in by_bytes(batch, 2):
                h, at = shingle_sets(_texts(part.column(2)), words)
                node = nodes.of(*_signatures(h, at))
                fresh = [k for k, s in enumerate(node.tolist()) if s not in seen and not seen.add(s)]
                if len(seen) > 1_000_000:
                    seen = set()
                size = np.diff(at)
                keep = np.zeros(len(size), bool)
                keep[fresh] = True
                h = h[np.repeat(keep, size)]
                sig, of = classes.first(h, np.concatenate([[0], np.cumsum(np.where(keep, size, 0))]), hot_h, hot_n)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[of])], ["h", "node"])

    return docs.mapInArrow(run, "h long, node long")


class Region:
    """The sets of a region of bounded size, joined in one task."""

    def __init__(self, sets: list[np.ndarray], percent: int, leaf: int, pivots: int):
        self.percent, self.leaf, self.pivots = percent, leaf, pivots
        self.reach = 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        self.component = np.arange(len(sets))
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, column, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        shared = count[column] > 1  # what one set alone has is in no intersection
        self.owner, self.column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        self.columns = int((count > 1).sum())

    def links(self) -> list[tuple[int, int]]:
        """Links that join all components, each a set's number and that of the first set of its component."""
        todo = [np.arange(len(self.size))]
        while todo:
            members = todo.pop()
            if len(np.unique(self.component[members])) > 1:
                todo += self._cells(members) if len(members) > self.leaf else self._compare(members)
        return [(i, int(c)) for i, c in enumerate(self.component.tolist()) if i != c]

    def _join(self, members: np.ndarray, k: int) -> None:
        """Puts ``members`` and set ``k`` into one component."""
        some = np.unique(self.component[np.append(members, k)])
        if len(some) > 1:
            self.component[np.isin(self.component, some)] = some[0]

    def _linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)

    def _cells(self, members: np.ndarray) -> list[np.ndarray]:
        """Voronoi cells with their windows; none where they are hardly smaller than the region, which is then compared whole."""
        at = np.full(len(self.size), -1)
        at[members] = np.arange(len(members))
        inside = at[self.owner] >= 0
        owner, column = at[self.owner[inside]], self.column[inside]
        pivots = members[np.linspace(0, len(members) - 1, self.pivots).astype(np.int64)]
        distance = np.empty((len(pivots), len(members)))
        for row, p in enumerate(pivots.tolist()):
            has = np.zeros(self.columns, bool)
            has[column[owner == at[p]]] = True
            shared = np.bincount(owner[has[column]], minlength=len(members))
            shared[at[p]] = self.size[p]
            distance[row] = 1 - shared / (self.size[members] + self.size[p] - shared)
            self._join(members[self._linked(shared, self.size[members], self.size[p])], p)
        nearest = distance.min(0)
        cells = []
        for row in distance:
            radius = row[row <= nearest].max(initial=-1.0)
            cells.append(members[(row <= nearest + 2 * self.reach + 1e-9) & (row <= radius + self.reach + 1e-9)])
        return cells if max(map(len, cells)) <= 0.8 * len(members) else self._compare(members)

    def _compare(self, members: np.ndarray, block: int = 1024, width: int = 8192) -> list[np.ndarray]:
        """Compares all pairs, block by block of sets and of shingles."""
        at = np.full(len(self.size), -1)
        at[members] = np.arange(len(members))
        inside = at[self.owner] >= 0
        owner, column = at[self.owner[inside]], self.column[inside]
        _, column, count = np.unique(column, return_inverse=True, return_counts=True)
        owner, column = owner[count[column] > 1], (np.cumsum(count > 1) - 1)[column[count[column] > 1]]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        cuts = np.searchsorted(column, np.arange(0, int((count > 1).sum()) + width, width))

        def dense(start: int, k: int) -> np.ndarray:
            o, c = owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]]
            some = (o >= start) & (o < start + block)
            out = np.zeros((min(block, len(members) - start), width), np.float32)
            out[o[some] - start, c[some] - k * width] = 1
            return out

        for i in range(0, len(members), block):
            for j in range(i, len(members), block):
                shared = np.zeros((min(block, len(members) - i), min(block, len(members) - j)), np.float32)
                for k in range(len(cuts) - 1):
                    x = dense(i, k)
                    shared += x @ (x if i == j else dense(j, k)).T
                a, b = self.size[members[i : i + block]], self.size[members[j : j + block]]
                linked = self._linked(shared.astype(np.int64), a[:, None], b[None])
                for row in np.flatnonzero(linked.any(1)).tolist():
                    self._join(members[j + np.flatnonzero(linked[row])], int(members[i + row]))
        return []


def parities(h: np.ndarray) -> bytes:
    """Whether the number of a set's shingles in each slot is odd: one bit a slot, of which there are a power of two, at least as many as shingles."""
    slots = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer slots."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def possible_groups(size: np.ndarray, bits: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Groups of two or more sets (``size``, and ``bits`` of ``parities``) that chains of possible links join; all links are inside of groups."""
    order = np.argsort(size, kind="stable")
    n, own = size[order], [bits[i] for i in order.tolist()]
    group, members = np.arange(len(n)), {}
    last = np.searchsorted(n, n * 100 // percent, side="right")  # larger ones don't link
    words, level, first = 0, None, 0
    for i in range(len(n)):
        if last[i] == i + 1:
            continue
        if len(own[i]) != words:
            words, first = len(own[i]), i
            level = np.stack([_folded(x, words) for x in own[i:]])
        at = i - first
        apart = np.bitwise_count(level[at + 1 : last[i] - first] ^ level[at]).sum(1, dtype=np.int64)
        near = i + 1 + np.flatnonzero((100 + percent) * apart <= (100 - percent) * (n[i] + n[i + 1 : last[i]]))
        for g in set(group[near].tolist()) - {group[i]}:
            into, gone = members.setdefault(int(group[i]), [int(group[i])]), members.pop(g, [g])
            into += gone
            group[gone] = group[i]
    return [order[sorted(m)] for m in members.values()]


def _possible(regions: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Regions (region, node) as the groups of nodes that may link, each once; sketches: node, n, bits."""

    def run(batches):
        region, nodes, size, bits = None, [], [], []

        def groups():
            out = [np.array(nodes, np.int64)[g] for g in possible_groups(np.array(size, np.int64), bits, percent)] if len(nodes) > 1 else []
            name = [xxhash.xxh3_64_intdigest(np.sort(g).tobytes()) for g in out]
            names = np.repeat(np.array(name, np.uint64), [len(g) for g in out]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))], ["region", "node"])

        for batch in batches:
            for r, node, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != region:
                    yield groups()
                    region, nodes, size, bits = r, [], [], []
                nodes.append(node)
                size.append(n)
                bits.append(np.frombuffer(raw, np.uint64))
        yield groups()

    rows = regions.select("region", "node").join(sketches, "node").select("region", "node", "n", "bits")
    return rows.repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "region long, node long").distinct()


def _joined_regions(regions: DataFrame, sets: DataFrame, percent: int, leaf: int) -> DataFrame:
    """a, b: links that join the components of each region (region, node)."""

    def run(batches):
        region, nodes, held = None, [], []

        def links():
            found = Region(held, percent, leaf, 8).links() if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for r, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != region:
                    yield links()
                    region, nodes, held = r, [], []
                nodes.append(node)
                held.append(np.frombuffer(raw, np.uint64))
            give_back()
        yield links()

    rows = regions.select("region", "node").join(sets.select("node", "shingles"), "node").select("region", "node", "shingles")
    return rows.repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "a long, b long")


def _sized(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Each region's number of nodes (m) and of shingles (s)."""
    return regions.join(sets.select("node", "n"), "node").groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("s"))


def _cut(regions: DataFrame, sets: DataFrame, percent: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Regions too large for a task, cut into the Voronoi cells of a few of their nodes, with windows: region, node, m of
    the region that was cut; and the links to those pivots."""
    reach = 1 - percent / 100
    first = Window.partitionBy("region").orderBy(F.xxhash64("node", "region"))
    chosen = regions.withColumn("k", F.row_number().over(first)).where(F.col("k") <= pivots).join(sets, "node")
    chosen = chosen.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "shingles"))).alias("pivots"))  # ``pivots`` of them at most

    def run(batches):
        for batch in batches:
            out = []
            for region, node, m, raw, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, distance, linked = np.frombuffer(raw, np.uint64), [], []
                for p in own:
                    y = np.frombuffer(p["shingles"], np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    distance.append(1 - shared / (len(x) + len(y) - shared))
                    if 100 * shared >= percent * (len(x) + len(y) - shared) and node != p["node"]:
                        linked.append(p["node"])
                out.append((region, node, m, [own[k]["node"] for k, d in enumerate(distance) if d <= min(distance) + 2 * reach + 1e-9], linked))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["region", "node", "m", "cells", "linked"])

    rows = regions.join(sets.select("node", "shingles"), "node").join(chosen, "region").select("region", "node", "m", "shingles", "pivots")
    done = materialise(rows.mapInArrow(run, "region long, node long, m long, cells array<long>, linked array<long>"), "join-cells")
    cells = done.select("m", F.explode("cells").alias("p"), "region", "node").select(F.xxhash64("region", "p").alias("region"), "node", "m")
    return cells, done.select(F.col("node").alias("a"), F.explode("linked").alias("b"))


def _links(regions: DataFrame, sets: DataFrame, percent: int, leaf: int, max_nodes: int, max_shingles: int) -> DataFrame:
    """a, b: verified links that join the components of the regions (region, node)."""
    found = []
    while True:
        sized = materialise(_sized(regions, sets), "join-sizes")
        over = sized.where((F.col("m") > max_nodes) | (F.col("s") > max_shingles))
        if over.isEmpty():
            break
        fits = regions.join(over, "region", "left_anti").select("region", "node")
        found.append(materialise(_joined_regions(fits, sets, percent, leaf), "join-links"))
        cells, linked = _cut(regions.join(over.select("region", "m"), "region"), sets, percent, pivots=8)
        found.append(linked)
        sizes = _sized(cells, sets).join(cells.groupBy("region").agg(F.first("m").alias("was")), "region")
        alike = materialise(sizes.where(F.col("m") > 0.8 * F.col("was")), "join-alike")
        # Windows don't part these: the blocks of such a region are compared two by two.
        blocks = F.ceil(F.greatest(2 * F.col("m") / max_nodes, 2 * F.col("s") / max_shingles)).cast("int") + 1
        split = cells.select("region", "node").join(alike.select("region", blocks.alias("blocks")), "region").withColumn("one", F.pmod(F.xxhash64("node"), F.col("blocks")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        split = split.select(F.xxhash64("region", F.least("one", "other"), F.greatest("one", "other")).alias("region"), "node")
        found.append(materialise(_joined_regions(split, sets, percent, leaf), "join-links"))
        regions = materialise(cells.select("region", "node").join(alike, "region", "left_anti"), "join-regions")
    found.append(materialise(_joined_regions(regions, sets, percent, leaf), "join-links"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of ``edges`` (a, b); nodes of no edge have no row.

    Labels fall to the smallest neighbour's and jump to their label's label, until none changes.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "component-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"), "component-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        own = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        new = materialise(own.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), (F.col("component") != F.least("next", F.coalesce("beyond", "next"))).alias("moved")), "component-labels")
        labels = new.select("node", "component")
        if not new.agg(F.max("moved")).head()[0]:
            return labels


def _frequent(first: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures counted most often, in order, and their counts; as many whole classes of counts as fit in ``most``."""
    hot = first.where("hot is not null").select(F.explode("hot").alias("x")).groupBy(F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n"))
    hot = materialise(hot.withColumn("class", F.floor(4 * F.log2("n")).cast("int")), "join-frequent")
    room, least = most, None
    for r in sorted(hot.groupBy("class").count().collect(), reverse=True):  # 256 rows at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["class"]
    rows = sorted((r["h"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in hot.where(F.col("class") >= least).select("h", "n").collect()) if least is not None else []
    return np.array([h for h, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def join_components(docs: DataFrame, words: int = 4, percent: int = 85, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text; other columns are ignored).

    Rows link when their sets of ``words``-word shingles have a Jaccard similarity of at least ``percent`` per
    cent; component_id is the smallest doc_id that links reach, nulls last. A null text, or one without words, has
    an empty set and is its own component. Each of repeated rows is returned. An empty table gives no rows.

    ``local_hot`` and ``max_hot`` bound the list of frequent signatures that go last in the common order, which
    changes how much is compared and not what is found; ``leaf`` is the size of a region that is joined pair by
    pair, ``max_nodes`` and ``max_shingles`` bound what one task joins.
    """
    return _joined(docs, words, percent, **how).select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame, words: int, percent: int, local_hot: int = 4, max_hot: int = 200_000, leaf: int = 256, max_nodes: int = 4096, max_shingles: int = 4_000_000) -> DataFrame:
    """``join_components`` with the hash of each row's text as th, and the row that stands for its component as best
    (its doc_id, nulls last, and th)."""
    classes = SizeClasses(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    first = materialise(_sets(rows, words, classes, local_hot), "shingle-sets")
    hot_h, hot_n = _frequent(first, max_hot)
    every = first.where("a is not null").select("doc_id", "th", "n", "a", "b")
    clashes = every.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("a")
    clashes = every.join(clashes, "a").select("a", "b").distinct().collect()  # pairs of sets that share 64 bits of their hash: none below billions of sets
    nodes = Nodes([tuple(r) for r in clashes])
    if nodes.other:
        renamed = docs.sparkSession.createDataFrame([(a, b, node) for a, of in nodes.other.items() for b, node in of.items()], "a long, b long, node long")
        every = every.join(F.broadcast(renamed), ["a", "b"], "left").withColumn("node", F.coalesce("node", "a"))
    else:
        every = every.withColumn("node", F.col("a"))

    def of_nodes(wanted, kind, made):
        """node, n and what ``made`` makes of its set, for each of the ``wanted`` nodes, from one document that has it."""

        def run(batches):
            for batch in batches:
                for part in by_bytes(batch, 1):
                    h, at = shingle_sets(_texts(part.column(1)), words)
                    want = part.column(0).to_numpy()
                    keep = np.flatnonzero(nodes.of(*_signatures(h, at)) == want).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(want[keep]), pa.array(np.diff(at)[keep]), pa.array([made(h[at[k] : at[k + 1]]) for k in keep], pa.binary())], ["node", "n", kind])

        holder = every.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("x")).select(F.col("node").alias("want"), F.col("x.th").alias("t"), F.col("x.doc_id").alias("d"))
        holder = materialise(holder, "join-holders")
        if holder.count() <= 1_000_000:  # 24 bytes a row
            holder = F.broadcast(holder)
        texts = rows.join(holder, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("want", "text")
        return materialise(texts.mapInArrow(run, f"node long, n long, {kind} binary").dropDuplicates(["node"]), f"join-{kind}")

    with listed_scratch() as made:
        postings = _postings(rows, words, classes, nodes, hot_h, hot_n)
        by_signature = Window.partitionBy("h")
        shared = postings.withColumn("region", F.min("node").over(by_signature)).withColumn("hi", F.max("node").over(by_signature)).where("region <> hi")
        regions = materialise(shared.select("region", "node").distinct(), "join-regions")
        sketches = of_nodes(regions, "bits", parities)
        sized = materialise(_sized(regions, sketches), "join-sizes")
        over = sized.where((F.col("m") > max_nodes) | (F.col("s") > max_shingles)).select("region")
        fits, large = regions.join(over, "region", "left_anti"), regions.join(over, "region", "left_semi")
        regions = materialise(_possible(fits, sketches, percent).unionByName(large.select("region", "node")).distinct(), "join-regions")
        sets = of_nodes(regions, "shingles", lambda x: x.tobytes())
        links = _links(regions, sets, percent, leaf, max_nodes, max_shingles)
        components = connected_components(links).withColumnRenamed("component", "c")
    discard(docs.sparkSession, made[:-1])  # the last holds the components
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    smallest = every.where("n > 0").groupBy("node").agg(F.min(best).alias("best")).join(components, "node", "left").withColumn("c", F.coalesce("c", "node"))
    labels = smallest.groupBy("c").agg(F.min("best").alias("best"))
    by_set = smallest.select("node", "c").join(labels, "c").select("node", "best")
    return every.join(by_set, "node", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "best")


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the copies: of each component the row with the smallest
    doc_id stays (nulls last, ties by a hash of the text), and one of rows that repeat both its doc_id and text.

    Rows without words link to nothing and all stay, repeated ones too. An empty table gives no rows. Columns of ``docs`` other than doc_id and text
    play no part; their names may be any that don't start with ``_join_``.
    """
    with listed_scratch() as made:
        of_rows = _joined(docs, words, percent, **how).where("n_shingles > 0").select(F.col("doc_id").alias("_join_id"), F.col("th").alias("_join_th"), "best")
    joined = materialise(of_rows, "join-rows")
    discard(docs.sparkSession, made)
    same = F.col("_join_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_join_th") == F.col("best.th"))
    of_row = F.col("doc_id").cast("long").eqNullSafe(F.col("_join_id")) & (F.xxhash64("text") == F.col("_join_th"))
    kept = docs.join(joined.where(~same).select("_join_id", "_join_th").distinct(), of_row, "left_anti")
    repeated = joined.where(same).groupBy("_join_id", "_join_th").count().where("count > 1").select("_join_id", "_join_th")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, of_row).dropDuplicates(["_join_id", "_join_th"]).select(*docs.columns)
    return kept.join(repeated, of_row, "left_anti").unionByName(once)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
