"""Hard negatives against a brute-force version."""

import math
import random

import pytest

from oddsmill.llm.hard_negatives import hard_negatives, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, block int, score string"


def embeddings(spark, rows):
    """Embeddings with further columns whose names clash with those that the operator uses."""
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, every=100, positives=5, negatives=10):
    kept = set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        q = tuple(max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * single(x)))) for x in v)
        kept.add((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    out = []
    order = lambda x: (-x[0], x[1][0] is None, x[1][0] or 0)
    for a in kept:
        if a[0] is None or a[0] % every:
            continue
        scores = sorted(((sum(x * y for x, y in zip(a[2], b[2], strict=False)), b) for b in kept if b != a), key=order)
        for p, pos in [(s, b) for s, b in scores if b[1] == a[1]][:positives]:
            window = [(s, b) for s, b in scores if b[1] != a[1] and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(a[0], pos[0], k + 1, b[0], p, s) for k, (s, b) in enumerate(window)]
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(r, n, width=12):
    base = [[r.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    near = lambda k, noise: [x + r.gauss(0, noise) for x in base[k]]
    rows = [(i, near(r.randrange(3), 0.7), r.randrange(4)) for i in range(n)]
    return rows + [(n + i, near(0, 0.01), r.randrange(2)) for i in range(n)]  # a third of all alike


@pytest.mark.parametrize(("block_rows", "group_anchors"), [(20, 3), (1000, 1000)])
def test_windows_equal_brute_force_however_rows_are_dealt(spark, block_rows, group_anchors):
    rows = made(random.Random(block_rows), 150)
    out = hard_negatives(embeddings(spark, rows), every=20, block_rows=block_rows, group_anchors=group_anchors, least_rows=50)
    assert told(out) == brute(rows, every=20) != []


def test_odd_rows(spark):
    r = random.Random(4)
    rows = made(r, 60)
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf"), 1.0], 1), (500, [1.0], None), (None, rows[3][1], 1), (None, rows[4][1], 2)]
    rows += [(600, [], 3), (601, [], 3), (700, [1.0] * 20, 2), (701, [0.5] * 30, 2), (702, [0.4] * 3, 1)]  # vectors of other lengths
    rows += [rows[0], rows[0], (0, rows[1][1], 2), (0, rows[0][1], 3)]  # repeated rows, and other rows of the same id
    rows += [(800 + k, [0.25] * 12, k % 2) for k in range(40)]  # ties
    assert told(hard_negatives(embeddings(spark, rows), block_rows=40, least_rows=20)) == brute(rows) != []


def test_large_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * 1e6 for _ in range(4)], i % 3) for i in range(120)]
    assert told(hard_negatives(embeddings(spark, rows), every=10, block_rows=30, least_rows=10)) == brute(rows, every=10) != []


def test_empty_table(spark, tmp_path):
    embeddings(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op12_hard_negatives(spark, str(tmp_path)).collect() == []


def test_pruned_search_gives_all_pairs_over_the_threshold():
    import numpy as np

    from oddsmill.llm.hard_negatives import Block, _tails

    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(500, 40)) * (40 / np.arange(1, 41)))
    block = Block(x, list(range(500)), np.zeros(500, np.int64), np.arange(500))
    q = np.floor(r.normal(size=(7, 40)) * 20)[:, block.order]
    for least in (-5000.0, 0.0, 500.0, 2000.0, 9000.0):
        want = q @ block.x.T
        one, row, score = block.reach(slice(0, 500), q, _tails(q), np.full(7, least))
        assert sorted(zip(one.tolist(), row.tolist(), score.tolist(), strict=True)) == [(a, b, want[a, b]) for a in range(7) for b in range(500) if want[a, b] >= least]
