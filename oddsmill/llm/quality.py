"""Quality rules: suffix-array repetition within a document, beside plain counts of its words and lines.

The words of a batch of documents stand in one array. Prefix doubling sorts its suffixes, document by
document; each round sorts only the suffixes that are still tied. The longest common prefix of neighbours comes
from the ranks of the rounds, and the larger of a suffix's two neighbours is the length of the longest
repeated passage that starts there: the depth of its longest-common-prefix interval. The union of those
passages is the covered part of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import WS_BYTES, give_back, table

RESULT = (
    "doc_id long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, kept boolean"
)
_WORDS_PER_BATCH = 150_000
_SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros(256, np.uint8)
_KIND[128:192] = 2  # continuation bytes are not code points
_KIND[list(WS_BYTES)] = 2
_IS_SYMBOL = np.zeros(256, np.uint8)
_IS_SYMBOL[list(_SYMBOLS)] = 1


def longest_repeats(words: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """For each position, the length in words of the longest passage from there that its document has again.

    ``words`` holds word numbers, ``doc_of`` the ascending document number of each.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc_of, doc_of, side="right")
    code = doc_of.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(code, kind="stable")
    first = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    active = order[~(first & np.append(first[1:], True))]
    while len(active):
        ahead = active + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        group = rank[active]
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(active))
        slot = group + at - np.maximum.accumulate(np.where(opens, at, 0))
        splits = opens | np.concatenate([[True], second[1:] != second[:-1]])
        new = np.maximum.accumulate(np.where(splits, slot, 0))
        rank = rank.copy()
        rank[active] = new
        levels.append(rank.astype(np.int32))
        h *= 2
        active = active[~(splits & np.append(splits[1:], True))]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[tied], b[tied]
    common = np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        common[same] += 1 << k
    out = np.zeros(n, np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions lie in the union of the spans [i, i + lengths[i])."""
    at = np.arange(len(lengths))
    return np.maximum.accumulate(at + lengths) > at if len(lengths) else np.zeros(0, bool)


def measure(texts: list[bytes], min_words: int) -> dict[str, np.ndarray]:
    """The counts of each text (UTF-8), documented at ``quality``."""
    n = len(texts)
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(counts.sum()))
    doc_of = np.repeat(np.arange(n), counts)
    repeats = longest_repeats(flat, doc_of)

    def per_doc(x):
        return np.bincount(doc_of, weights=x, minlength=n).astype(np.int64)

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc_of, np.where(repeats >= min_words, repeats, 0))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    byte_doc = np.repeat(np.arange(n), [len(t) for t in texts])
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(WS_BYTES)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": np.bincount(byte_doc[_KIND[raw] == 0], minlength=n).astype(np.int64),
        "n_symbols": np.bincount(byte_doc[_IS_SYMBOL[raw] == 1], minlength=n).astype(np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": per_doc(covered(np.where(repeats >= 3, 3, 0))),
        "covered_words": per_doc(covered(np.where(repeats >= min_words, repeats, 0))),
        "longest_repeat": longest,
    }


def _by_size(batch: pa.RecordBatch, text: int):
    """Slices with texts of about six bytes for each word of a batch; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        if k > at and size + n > 6 * _WORDS_PER_BATCH:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def _verdict(m: dict[str, np.ndarray], max_covered: float, max_longest: float) -> tuple[np.ndarray, np.ndarray]:
    w = m["n_words"]
    failed = (w < 50) | (100 * m["n_repeat_words"] > 50 * w)
    return failed, ~failed & (m["covered_words"] <= max_covered * w) & (m["longest_repeat"] <= max_longest * w)


def quality(docs: DataFrame, min_words: int = 10, max_covered: float = 0.3, max_longest: float = 0.2) -> DataFrame:
    """Counts and verdict of each row of ``docs`` (doc_id, text; other columns are ignored).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. kept: not
    base_failed, repeated passages of ``min_words`` words or more cover at most ``max_covered`` of the words,
    and the longest of them is at most ``max_longest`` of the words. Whole texts are taken; a null or empty text has
    no words and fails; repeated rows are judged each; an empty table gives no rows. ``row`` is the number
    of the row in ``docs``.
    """

    def run(batches):
        for b in batches:
            for part in _by_size(b, 2):
                m = measure([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()], min_words)
                failed, kept = _verdict(m, max_covered, max_longest)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0), "row": part.column(1)}
                    | {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                    | {"base_failed": failed, "covered_words": m["covered_words"], "longest_repeat": m["longest_repeat"], "kept": kept}
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def accepted(docs: DataFrame, min_words: int = 10, max_covered: float = 0.3, max_longest: float = 0.2) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality`` keeps.

    A null or empty text fails; repeated rows are judged each, so all or none of them stay; there are no ties, as a row's verdict
    depends on its text alone; columns other than ``text`` may have any name; an empty table gives no rows.
    """
    where = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for part in _by_size(b, where):
                texts = [t or b"" for t in part.column(where).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(_verdict(measure(texts, min_words), max_covered, max_longest)[1], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("row")
