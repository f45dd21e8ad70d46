"""Brown class-based n-gram scoring.

Every word has a class, and P(w | v) = P(class(w) | context(v)) P(w | class(w)). Contexts are classes too, in the form that lets
the two differ (asymmetric clustering): they come from exchange clustering of symbols, which are the most frequent words, the end of a
document, and one for each ending that the other words share, so also a word never seen is a context.

The classes of words come from exchange clustering of all word types: a word moves to the class that raises the likelihood most, given
how often each context stands before it. Those counts, of every word and context over all training documents, are taken
once into a distributed table; a round is one pass over it with the matrix of contexts and classes, in which each task moves its
words (half of them a round, as words that move at once don't see each other). The matrix that a round leaves is all
that the next needs, so rounds shuffle a few thousand cells.

Scores of a text need the classes of its words: the most frequent are held by each task, the others are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import WS_BYTES, by_bytes, crc_bucket, materialise, table

END = b"\n"  # no word is that
_PART = 12_000_000  # bytes of text in which words are counted at once
_SPACE = np.zeros(256, bool)
_SPACE[list(WS_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of all texts as numbers of distinct ones, where each text's begin (with the end of the last), and the
    distinct tokens: words, lower-cased (A-Z), and after each text the end."""
    raw = _LOWER[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    space = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    opens, size = turns[::2], turns[1::2] - turns[::2]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(raw[~space])]).dictionary_encode()
    ends = np.searchsorted(opens, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    distinct = [*words.dictionary.to_pylist(), END]
    starts = np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])
    return np.insert(words.indices.to_numpy().astype(np.int64), ends, len(distinct) - 1), starts, distinct


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts`` (text)."""

    def run(batches):
        for b in batches:
            for part in by_bytes(b, 0, _PART):
                codes, _, distinct = tokens_of(_texts(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts: whole groups of alike counts, ``most`` words at most, so that no more
    than those reach the driver."""
    n = F.col("n")
    level = F.when(n <= 1000, n).otherwise(1000 + F.floor(16 * F.log2(n))).cast("long")
    room, least = most, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # about 2,000 rows at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    rows = counts.where(level >= least).collect() if least is not None else []
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def ending_codes(words: list[bytes]) -> np.ndarray:
    """A hash of 24 bits of the last three bytes of each word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 3)
    raw = np.frombuffer(b"".join([b"\0\0\0" + w for w in words]), np.uint8).astype(np.int64)
    code = raw[ends - 1] | raw[ends - 2] << 8 | raw[ends - 3] << 16
    return (code * 0x9E3779B1 & 0xFFFFFFFF) >> 8


def half_of(words: list[bytes]) -> np.ndarray:
    """Whether a word moves in even or in odd rounds."""
    return ending_codes(words) & 1


@dataclass
class Symbols:
    """Numbers of the symbols: the end and the frequent words first, then the endings."""

    words: dict[bytes, int]
    endings: int

    def __len__(self) -> int:
        return len(self.words) + self.endings

    def of(self, distinct: list[bytes]) -> np.ndarray:
        get = self.words.get
        own = np.array([get(w, -1) for w in distinct], np.int64)
        return np.where(own < 0, self.ending(distinct), own)

    def ending(self, distinct: list[bytes]) -> np.ndarray:
        return len(self.words) + ending_codes(distinct) % self.endings


def _with_left(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; before a text, an end."""
    left = np.concatenate([[end], codes[:-1]])
    left[starts[:-1]] = end
    return left


def count_bigrams(texts: DataFrame, symbols: Symbols, slices: int = 16, lanes: int = 16) -> np.ndarray:
    """Matrix of symbol bigrams over all rows of ``texts`` (text); each text follows an end.

    A task adds up its own matrix; the slices of these are added in two steps, first in lanes, so that no task reads those of all.
    """
    size, end = len(symbols), symbols.words[END]
    rows_each = -(-size // slices)

    def sparse(parts: dict[int, np.ndarray], lane: int):
        for s, part in parts.items():
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([lane], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([part[at].astype("<i8").tobytes()], pa.binary())], ["slice", "lane", "at", "n"])

    def local(batches):
        total = np.zeros(slices * rows_each * size, np.int64)
        for b in batches:
            for part in by_bytes(b, 0, _PART):
                codes, starts, distinct = tokens_of(_texts(part.column(0)))
                ids = symbols.of(distinct)[codes]
                cell, n = np.unique(_with_left(ids, starts, end) * size + ids, return_counts=True)
                total[cell] += n
        yield from sparse(dict(enumerate(total.reshape(slices, -1))), TaskContext.get().partitionId() % lanes)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, _, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault(s, np.zeros(rows_each * size, np.int64))[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")
        yield from sparse(sums, 0)

    kind = "slice int, lane int, at binary, n binary"
    added = texts.mapInArrow(local, kind).repartition("slice", "lane").mapInArrow(add, kind).repartition("slice").mapInArrow(add, kind)
    out = np.zeros((slices, rows_each * size), np.int64)
    for r in added.collect():  # as large as the symbols' matrix
        out[r["slice"], np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["n"], "<i8")
    return out.reshape(-1)[: size * size].reshape(size, size)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of each symbol by exchange clustering, from classes of alike total count in the order of frequency."""
    n = bigrams.astype(np.float64)
    total = n.sum(1)
    size = len(n)
    order = np.argsort(-total, kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    one = np.eye(classes)[of]
    left, right = n @ one, n.T @ one  # counts of symbol then class, and of class then symbol
    pairs = one.T @ left
    sums, before = pairs.sum(1), pairs.sum(0)
    self_loop = np.diag(n)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w] and not right[w].sum():
                continue
            c = of[w]
            out, into, twice = left[w].copy(), right[w].copy(), self_loop[w]
            out[c] -= twice  # without the symbol's pair with itself
            into[c] -= twice
            pairs[c] -= out
            pairs[:, c] -= into
            pairs[c, c] -= twice
            sums[c] -= total[w]
            before[c] -= into.sum() + twice
            base_rows = _plogp(pairs)
            gain = (_plogp(pairs + out) - base_rows).sum(1) + (_plogp(pairs.T + into) - base_rows.T).sum(1)
            # The cell of a class with itself gets both; correct its two separate gains.
            d, o, i = np.diag(pairs), out, into
            gain += _plogp(d + o + i + twice) - _plogp(d + o) - _plogp(d + i) + _plogp(d)
            gain -= _plogp(sums + total[w]) - _plogp(sums) + _plogp(before + into.sum() + twice) - _plogp(before)
            k = int(gain.argmax())
            if gain[k] <= gain[c] + 1e-9:
                k = c
            pairs[k] += out
            pairs[:, k] += into
            pairs[k, k] += twice
            sums[k] += total[w]
            before[k] += into.sum() + twice
            if k != c:
                of[w], moved = k, moved + 1
                left[:, c] -= n[:, w]
                left[:, k] += n[:, w]
                right[:, c] -= n[w]
                right[:, k] += n[w]
        if moved * 100 < size:
            break
    return of


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries of a column in one array, and how many each has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(at) // width


def _binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


CONTEXTS = "word binary, start short, half short, contexts binary, times binary"


def count_contexts(texts: DataFrame, symbols: Symbols, context: np.ndarray, classes: int) -> DataFrame:
    """How often each context stands before each word: contexts (one byte each, ascending) and times (four bytes each), with the class
    where the word starts, that of its symbol, and the half that it moves with."""

    def run(batches):
        for b in batches:
            for part in by_bytes(b, 0, _PART):
                codes, starts, distinct = tokens_of(_texts(part.column(0)))
                left = _with_left(context[symbols.of(distinct)][codes], starts, int(context[symbols.words[END]]))
                cell, n = np.unique(codes * classes + left, return_counts=True)
                twice = 1 + (n - 1) // 65_535  # two bytes each; larger counts are several entries
                cell, n = np.repeat(cell, twice), np.repeat(-(-n // twice), twice) - (np.arange(twice.sum()) - np.repeat(np.cumsum(twice) - twice, twice) >= np.repeat(twice - (-n) % twice, twice))
                word, size = np.unique(cell // classes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()).take(pa.array(word)), _binaries((cell % classes).astype(np.uint8), size), _binaries(n.astype("<u2"), size)], ["word", "contexts", "times"])

    def merged(batches):
        held, sums = None, np.zeros(classes, np.int64)  # the last word so far: more of it may come

        def rows(words: list[bytes], table: np.ndarray):
            at, g = np.nonzero(table)
            start = context[symbols.of(words)].astype(np.int16)
            half = half_of(words).astype(np.int16)
            size = np.bincount(at, minlength=len(words))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(start), pa.array(half), _binaries(g.astype(np.uint8), size), _binaries(table[at, g].astype("<i4"), size)], ["word", "start", "half", "contexts", "times"])

        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                part = b.slice(i, 10_000)
                words = part.column(0).to_pylist()
                fresh = np.array([True, *[x != y for x, y in zip(words[1:], words, strict=False)]])
                own, (g, size), (n, _) = np.cumsum(fresh) - 1, _flat(part.column(1), "u1"), _flat(part.column(2), "<u2")
                table = np.bincount(np.repeat(own, size) * classes + g, n, (int(own[-1]) + 1) * classes).astype(np.int64).reshape(-1, classes)
                names = [words[k] for k in np.flatnonzero(fresh).tolist()]
                if held == names[0]:
                    table[0] += sums
                elif held is not None:
                    names, table = [held, *names], np.vstack([sums[None], table])
                held, sums = names[-1], table[-1]
                if len(names) > 1:
                    yield rows(names[:-1], table[:-1])
        if held is not None:
            yield rows([held], sums[None])

    return texts.mapInArrow(run, "word binary, contexts binary, times binary").repartition("word").sortWithinPartitions("word").mapInArrow(merged, CONTEXTS)


@dataclass
class Rounds:
    """The rounds of exchange so far, by the matrix of contexts and classes that each saw."""

    seen: list[np.ndarray]

    def classes(self, start: np.ndarray, half: np.ndarray, size: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The class of each word after the rounds; ``size`` is the number of its entries in ``g`` (contexts) and ``n`` (times)."""
        of = start.astype(np.int64)
        owner, opens = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        total = np.bincount(owner, n, len(size))
        for k, pairs in enumerate(self.seen):
            sums, moving = pairs.sum(0), half == k % 2
            once = _plogp(pairs + 1) - _plogp(pairs)
            # Words seen once: what they gain depends on their context alone, so the two best classes of each context do.
            gain = once - (_plogp(sums + 1) - _plogp(sums))
            first, second = np.argsort(-gain, axis=1, kind="stable")[:, :2].T
            lose = _plogp(pairs) - _plogp(np.maximum(pairs - 1, 0)) - (_plogp(sums) - _plogp(np.maximum(sums - 1, 0)))
            single = np.flatnonzero(moving & (total == 1))
            at, own = g[opens[single]], of[single]
            best = np.where(first[at] == own, second[at], first[at])
            new = np.where(gain[at, best] > lose[at, own] + 1e-9, best, own)
            # The others by all their entries.
            others = np.flatnonzero(moving & (total > 1))
            some = (moving & (total > 1))[owner]
            og, on, oo = g[some], n[some].astype(np.float64), np.cumsum(size[others]) - size[others]
            if len(others):
                add = once[og]
                more = on != 1
                add[more] = _plogp(pairs[og[more]] + on[more, None]) - _plogp(pairs[og[more]])
                mine, t = of[others], total[others]
                gains = np.add.reduceat(add, oo, 0) - (_plogp(sums + t[:, None]) - _plogp(sums))
                cell = pairs[og, np.repeat(mine, size[others])]
                keep = np.add.reduceat(_plogp(cell) - _plogp(cell - on), oo) - (_plogp(sums[mine]) - _plogp(sums[mine] - t))
                gains[np.arange(len(others)), mine] = keep
                top = gains.argmax(1)
                of[others] = np.where(gains[np.arange(len(others)), top] > keep + 1e-9, top, mine)
            of[single] = new
        return of


def _entries(batches, rows: int = 20_000):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            (g, size), (n, _) = _flat(part.column(3), "u1"), _flat(part.column(4), "<i4")
            yield part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy(), size, g.astype(np.int64), n


def exchange_words(contexts: DataFrame, classes: int, rounds: int) -> tuple[Rounds, np.ndarray, np.ndarray, np.ndarray]:
    """The rounds, then the matrix of contexts and classes, and tokens and types of each class, that they leave."""
    done = Rounds([])
    while True:

        def sums(batches):
            pairs, types = np.zeros(classes * classes), np.zeros(classes, np.int64)
            for _, start, half, size, g, n in _entries(batches):
                of = done.classes(start, half, size, g, n)
                pairs += np.bincount(g * classes + np.repeat(of, size), n, classes * classes)
                types += np.bincount(of, minlength=classes)
            cells = np.concatenate([pairs, types]).astype(np.int64)
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

        cells = np.zeros(classes * classes + classes)
        for r in contexts.mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # cells of a small matrix
            cells[r["cell"]] = r["n"]
        pairs = cells[: classes * classes].reshape(classes, classes)
        if len(done.seen) == rounds:
            return done, pairs, pairs.sum(0), cells[classes * classes :]
        done.seen.append(pairs)


def class_table(contexts: DataFrame, done: Rounds) -> DataFrame:
    """word, n, class of every word of training."""

    def run(batches):
        for word, start, half, size, g, n in _entries(batches):
            total = np.bincount(np.repeat(np.arange(len(size)), size), n, len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([word, pa.array(total), pa.array(done.classes(start, half, size, g, n))], ["word", "n", "class"])

    return contexts.mapInArrow(run, "word binary, n long, class long")


@dataclass
class ClassModel:
    """What scoring needs of the model beside the table of words."""

    symbols: Symbols
    context: np.ndarray  # of symbols
    moves: np.ndarray  # log10 P(class | context)
    norm: np.ndarray  # log10 of tokens and smoothing of a class
    known: dict[bytes, tuple[int, int, int]]  # count, class and context of the most frequent words
    train_tokens: int
    base_norm: float


def _smoothed_moves(pairs: np.ndarray, prior: float = 10.0) -> np.ndarray:
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    return np.log10((pairs + prior * share) / (pairs.sum(1, keepdims=True) + prior))


def train(texts: DataFrame, classes: int, frequent: int, endings: int, in_memory: int, rounds: int) -> tuple[ClassModel, DataFrame]:
    """The model and the table of words."""
    counts = materialise(count_words(texts), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, in_memory)
    symbols = Symbols({w: i for i, w in enumerate({END: 0} | {w: 0 for w, _ in top[:frequent]})}, endings)
    context = exchange(count_bigrams(texts, symbols), classes)
    contexts = materialise(count_contexts(texts, symbols, context, classes), "word-contexts")
    done, pairs, tokens, types = exchange_words(contexts, classes, rounds)
    words = materialise(class_table(contexts, done), "word-classes")
    least = min((c for _, c in top), default=1 << 62)
    rows = [(bytes(r["word"]), r["n"], r["class"]) for r in words.where(F.col("n") >= least).collect()]  # the words of ``top``
    known = {w: (c, k, g) for (w, c, k), g in zip(rows, context[symbols.of([w for w, _, _ in rows])].tolist(), strict=True)}
    model = ClassModel(symbols, context, _smoothed_moves(pairs), np.log10(tokens + 0.5 * (types + 1)), known, int(n), float(np.log10(n + 0.5 * (v + 1))))
    return model, words


PARTS = "uid long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,context:short,n:int,unseen:double>>"


def score_texts(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    A task scores what it knows of a text at once, and other words as if training had none of them; those words then go with
    what stands before them to the table of words, where each that is there corrects its part.
    """
    own, none = model, float(np.log10(0.5))
    classes = len(own.moves)

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        none_known = (-1, 0, 0)

        def get(w):
            return own.known.get(w, none_known)

        for b in batches:
            for part in by_bytes(b, 1, _PART // 2):
                codes, starts, distinct = tokens_of(_texts(part.column(1)))
                found = np.array([*map(get, distinct)], np.int64).reshape(-1, 3)
                known = found[:, 0] >= 0
                ending = own.context[own.symbols.ending(distinct)]
                ending[-1] = own.context[own.symbols.words[END]]  # the end is a symbol even where it is no frequent word
                context, of = np.where(known, found[:, 2], ending), np.where(known, found[:, 1], ending)  # an unseen word's class is that of its ending
                logs = np.log10(np.maximum(found[:, 0], 0) + 0.5)
                left = _with_left(context[codes], starts, int(own.context[own.symbols.words[END]]))
                score = own.moves[left, of[codes]] + (logs - own.norm[of])[codes]
                doc = np.repeat(np.arange(part.num_rows), np.diff(starts))
                other = np.flatnonzero(~known[codes])
                cell, n = np.unique((doc[other] * len(distinct) + codes[other]) * classes + left[other], return_counts=True)
                g, rest = cell % classes, cell // classes % len(distinct)
                unseen = own.moves[g, of[rest]] + none - own.norm[of[rest]]
                struct = pa.StructArray.from_arrays([pa.array(distinct, pa.binary()).take(pa.array(rest)), pa.array(g.astype(np.int16)), pa.array(n.astype(np.int32)), pa.array(unseen)], ["word", "context", "n", "unseen"])
                cuts = np.searchsorted(cell // classes // len(distinct), np.arange(part.num_rows + 1))

                def per_doc(x, doc=doc, rows=part.num_rows):
                    return np.bincount(doc, x, rows)

                size = np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(part.num_rows)), part.column(0), pa.array(size), pa.array(per_doc(known[codes]).astype(np.int64)), pa.array(per_doc(logs[codes])), pa.array(per_doc(score)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), struct)],
                    ["uid", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
                )
                uid += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = materialise(rows.mapInArrow(run, PARTS), "class-model-texts")
    rest = parts.select("uid", F.explode("rest").alias("r")).select("uid", "r.*")
    moves, norm = F.lit(own.moves.reshape(-1).tolist()), F.lit(own.norm.tolist())
    log = F.log10(F.col("count") + 0.5)
    seen = F.element_at(moves, (F.col("context") * classes + F.col("class") + 1).cast("int")) + log - F.element_at(norm, (F.col("class") + 1).cast("int"))
    found = rest.join(words.select("word", F.col("n").alias("count"), "class"), "word").groupBy("uid").agg(
        F.sum("n").cast("long").alias("more"), F.sum(F.col("n") * (log - none)).alias("base_more"), F.sum(F.col("n") * (seen - F.col("unseen"))).alias("score_more")
    )
    out = parts.drop("rest").join(found, "uid", "left").fillna(0, ["more", "base_more", "score_more"])
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(own.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_more") - F.col("n_tokens") * F.lit(own.base_norm)).alias("base_score"), (F.col("score") + F.col("score_more")).alias("score"),
    )


def score_documents(docs: DataFrame, training: DataFrame, classes: int = 64, frequent: int = 1023, endings: int = 512, in_memory: int = 50_000, rounds: int = 2) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of all rows of ``training`` (text).

    Null and empty texts are an end token alone; repeated rows count, and are scored, each; whole texts of any
    length; other columns are ignored. Without training documents every word is unknown. An empty ``docs``
    gives no rows. There may be 256 ``classes`` at most.
    """
    model, words = train(training.select(F.col("text").cast("string").alias("text")), classes, frequent, endings, in_memory, rounds)
    return score_texts(docs, model, words)


def op3_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, docs.where(crc_bucket("doc_id", 5) != 1))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
