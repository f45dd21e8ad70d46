"""The stages of the pipeline as they are wired, against brute force over small documents, and the whole over odd and empty tables."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import ODD, brute_components, brute_quality, edits, prose, reference_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans long, _join long"
KEY = "AKIA" + "ABCDEFGH" * 2


def fold(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with documents (clean ones, copies, leaks, secrets, junk and odd rows) and a benchmark."""
    r = random.Random(21)
    items = [(k, prose(r, 25)) for k in range(4)] + [(9, None), (10, "")]
    rows = [(i, t) for i, t, _ in ODD]
    clean = [(100 + k, prose(r, r.randrange(60, 150))) for k in range(12)]
    rows += clean + [(200, clean[0][1]), (201, clean[1][1].upper()), (202, clean[2][1] + " more"), (100, clean[0][1]), (None, clean[3][1])]
    rows += [(300 + k, prose(r, 40) + " " + items[k][1][:-1] + " " + prose(r, 40)) for k in range(4)]
    rows += [(400, prose(r, 60) + f" key {KEY} here " + prose(r, 20)), (401, prose(r, 60) + " password: hunter2hunter2 " + prose(r, 20))]
    rows += [(500, "again and again " * 60), (501, prose(r, 20))]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", None, None, "x", None, 1) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items, {i for i, _ in clean}


def told(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


def test_each_stage_equals_brute_force(spark, made):
    path, rows, items, clean = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = rows
    for (name, stage), step in zip(corpus_pipeline.STAGES[:4], (good, lone, unleaked, redacted), strict=True):
        docs = corpus_pipeline.materialise(stage(spark, docs, path), "test")
        left = step(left, items)
        assert docs.columns == columns and told(docs) == sorted(left, key=str), name
    assert clean <= {i for i, _ in left} and not {200, 300, 301, 302, 303, 500, 501, 1, 2} & {i for i, _ in left}
    assert all(x.n_chars == len(x.text) for x in docs.collect())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    whole = {i: [*reference_ids("byte_bpe_50k.json", t), 0] for i, t in left}
    assert {p.doc_id: p.doc_tokens for p in packed} == {i: len(x) for i, x in whole.items()}
    assert all(p.ids_crc32 == zlib.crc32(np.array(whole[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in packed)
    again = corpus_pipeline.run(spark, path).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in again) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in packed)


def good(rows, items):
    out = []
    for i, t in rows:
        if len(t or "") > 5000:  # brute force is slow there: one word, and "a b" over and over
            continue
        n, _, _, _, repeated, covered, longest = brute_quality(t, 10)
        if n >= 50 and 100 * repeated <= 50 * n and covered <= 0.3 * n and longest <= 0.2 * n:
            out.append((i, t))
    return out


def lone(rows, items):
    parts = {}
    for (i, t), (_, n, c) in zip(rows, brute_components([(i, t, None) for i, t in rows], 5, 80), strict=True):
        parts.setdefault(c if n else ("none", i), []).append((i is None, i or 0, t))
    return [(None if x[0] else x[1], x[2]) for x in map(min, parts.values())]


def unleaked(rows, items):
    return [(i, t) for i, t in rows if not any(edits(fold(x), fold(t)) <= int(0.08 * len(fold(x))) for _, x in items if x)]


def redacted(rows, items):
    return [(i, re.sub(r"password: \w+", "[assign]", t.replace(KEY, "[access]"))) for i, t in rows]


def test_stages_over_empty_tables(spark, made, tmp_path):
    path = made[0]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, path).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_later_stages_keep_texts_that_are_null_or_empty(spark, made):
    docs = spark.createDataFrame([(k, t, None, None, None, None, None, None) for k, t in ((1, None), (1, None), (2, ""), (None, " "))], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert told(stage(spark, docs, made[0])) == told(docs)
    assert [(p.doc_tokens, p.length) for p in corpus_pipeline.STAGES[4][1](spark, docs, made[0]).where("doc_id < 3").collect()] == [(1, 1)] * 3


def test_stages_are_those_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
