"""Language identification by hierarchical discrimination.

A linear support vector machine for each family picks the family; one-versus-one machines between the
languages of that family then vote. Features are hashed counts of three successive bytes of the lower-cased
text, with everything but letters as a space, their square roots scaled to length one.

The machines are fitted on a bounded sample, at most ``per_lang`` documents of each language that the
training documents name; predictions take whole texts and nothing but the text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm._shared import by_bytes, crc_bucket, table

DIMS = 4096
# ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_WORDLIKE = re.compile(r"[^\W\d_]")
_LETTER_BYTES = np.full(256, 32, np.uint32)
_LETTER_BYTES[97:123] = np.arange(97, 123)
_LETTER_BYTES[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether a text has a letter; signs such as superscripts, fractions and circled numbers are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(texts: list[str], slice_bytes: int = 1 << 20) -> np.ndarray:
    """A row for each text: square roots of the counts of its trigrams of bytes by hash; a long text is counted in slices."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        raw, counts = np.frombuffer(f"  {t.lower()} ".encode(), np.uint8), np.zeros(DIMS, np.int64)
        for k in range(0, max(1, len(raw) - 2), slice_bytes):
            b = _LETTER_BYTES[raw[k : k + slice_bytes + 2]]
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
            counts += np.bincount(code, minlength=DIMS)
        out[i] = np.sqrt(counts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights and bias of a linear machine for y in {-1, 1}: squared hinge loss, classes weighed alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    step = 1 / (1 / cost + 4)
    for k in range(steps):
        at = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ at))
        last, w = w, at - step * (at / cost - 2 * ((share * y * slack) @ x))
    return w


@dataclass
class LanguageModel:
    families: list[str]
    family_w: np.ndarray
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[str, str, np.ndarray]]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter."""
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not some or not self.families:
            return langs, scores
        x = features([texts[i] for i in some])
        margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        for row, (i, m) in enumerate(zip(some, margins, strict=True)):
            best = int(m.argmax())
            sure = 1.0 if len(m) == 1 else 1 / (1 + np.exp(-2.0 * float(m[best] - np.delete(m, best).max())))
            family = self.families[best]
            votes = dict.fromkeys(self.langs[family], (0, 0.0))
            for a, b, w in self.pairs[family]:
                d = float(x[row] @ w[:-1] + w[-1])
                won, p = (a, d) if d >= 0 else (b, -d)
                votes[won] = (votes[won][0] + 1, votes[won][1] + p)
            langs[i] = max(votes, key=lambda k: (*votes[k], k))
            n, total = votes[langs[i]]
            scores[i] = float(min(1.0, sure * (1.0 if not n else 1 / (1 + np.exp(-4.0 * total / n)))))
        return langs, scores


def fit(labelled: DataFrame, per_lang: int = 250, seed: int = 11) -> LanguageModel:
    """Fits on rows with text and lang: at most ``per_lang`` of each language, drawn by a hash of doc_id.

    Rows without text, lang or a letter teach nothing; repeated rows may each be drawn; other columns are ignored; without any row the
    model says ``und``. The driver gets the features that a drawn text has, in half precision.
    """
    usable = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)))
    counts = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.count("*")).alias("share"))
    drawn = usable.join(F.broadcast(counts), "lang").where(F.col("h") < F.col("share") * 1_000_000)  # a row for each language
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    drawn = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang).select("lang", "text")

    def run(batches):
        for b in batches:
            for part in by_bytes(b, 1, most_rows=64):
                texts = part.column(1).to_pylist()
                x = features(texts)
                keep = [j for j, t in enumerate(texts) if has_letter(t)]
                at = [np.flatnonzero(x[j]) for j in keep]
                cols = [pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([x[j][a].astype("<f2").tobytes() for j, a in zip(keep, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), *cols], ["lang", "at", "x"])

    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in drawn.mapInArrow(run, "lang string, at binary, x binary").collect())
    langs = sorted({k for k, _, _ in rows})
    x = np.zeros((len(rows), DIMS), np.float32)
    for j, (_, at, v) in enumerate(rows):
        x[j, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f2")
    y = np.array([langs.index(k) for k, _, _ in rows])
    by_family: dict[str, list[str]] = {}
    for k in langs:
        by_family.setdefault(family_of(k), []).append(k)
    families = sorted(by_family)
    of = np.array([families.index(family_of(k)) for k in langs])[y] if langs else y
    weights = [fit_svm(x, np.where(of == i, 1, -1)) for i in range(len(families))] if len(families) > 1 else [np.zeros(DIMS + 1)] * len(families)
    pairs = {}
    for f, own in by_family.items():
        pairs[f] = []
        for a, b in itertools.combinations(own, 2):
            some = np.isin(y, [langs.index(a), langs.index(b)])
            pairs[f].append((a, b, fit_svm(x[some], np.where(y[some] == langs.index(a), 1, -1))))
    return LanguageModel(families, np.array(weights, np.float32).reshape(-1, DIMS + 1), by_family, pairs)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text), other columns kept out.

    Whole texts; a null text or one without a letter is ``und`` with score 0; repeated rows are each
    predicted, an empty table gives no rows, and a model without languages says ``und`` to all.
    """

    def run(batches):
        for b in batches:
            for part in by_bytes(b, 1, most_rows=128):
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_bucket("doc_id", 4) != 2).select("doc_id", "lang", "text"))
    return identify(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
