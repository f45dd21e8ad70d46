"""Min-max near duplicates against brute force, and the signatures against what they estimate."""

import random

import numpy as np
import pytest

from oddsmill.llm.jaccard_join import shingle_sets
from oddsmill.llm.minmax_dedup import MinMax, near_duplicates, op11_minmax_dedup
from tests.llm.test_operators import ODD, brute_components, docs, prose


def made(r):
    rows = list(ODD)
    for k in range(12):  # groups of copies with a few words changed, some of them linked by others only
        words = prose(r, r.choice([6, 30, 80, 200])).split()
        for j in range(r.randrange(1, 14)):
            w = list(words)
            for _ in range(r.randrange(0, 3) if len(w) > 30 else 0):
                w[r.randrange(len(w))] = f"x{r.randrange(5)}"
            rows.append((1000 + 20 * k + j, (" ".join(w[: len(w) - r.randrange(0, 2)])).upper() if j % 4 == 0 else " ".join(w), "en"))
    chain = prose(r, 120).split()
    rows += [(2000 + j, " ".join(chain[j * 4 : j * 4 + 90]), "en") for j in range(7)]  # each is linked to its neighbours
    rows += [(3000 + j, "one two three four", "en") for j in range(3)] + [(2500, rows[30][1], "en"), (None, rows[31][1], "de"), (None, rows[31][1], "de")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"lane_nodes": 2, "leaf": 2, "max_nodes": 5, "most": 0}, {"permutations": 160, "rows": 2}])
def test_components_equal_brute_force(spark, how):
    rows = made(random.Random(len(how)))
    got = near_duplicates(docs(spark, rows).repartition(3), **how).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(brute_components(rows, words=5), key=str)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_sets_left_apart_by_the_stars_are_joined_as_regions(spark):
    r = random.Random(3)
    words = prose(r, 100).split()  # a group of which many pairs are just below the threshold
    rows = []
    for j in range(40):
        w = list(words)
        for _ in range(2):
            w[r.randrange(len(w))] = f"y{j}"
        rows.append((j, " ".join(w), "en"))
    got = near_duplicates(docs(spark, rows), permutations=120, rows=2, lane_nodes=8).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(brute_components(rows, words=5), key=str)
    assert len({x.component_id for x in got}) > 1


def test_empty_table_and_query(spark, tmp_path):
    rows = made(random.Random(9))[:60]
    assert near_duplicates(docs(spark, [])).count() == 0
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_minmax_dedup(spark, str(tmp_path)).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == sorted(brute_components(rows, words=5), key=str)


def test_signatures_are_extremes_and_estimate_the_similarity():
    r = random.Random(1)
    base = [str(r.random()) for _ in range(400)]
    texts = [" ".join(base).encode(), " ".join(base[20:] + [str(r.random()) for _ in range(20)]).encode(), b"a b"]
    h, at = shingle_sets(texts, 5)
    hashing = MinMax(200, 5)
    values = hashing.values(h, at[:-1])
    k = 7
    of = lambda s: (s ^ hashing.xor[k]) * hashing.times[k]
    for i in range(3):
        own = of(h[at[i] : at[i + 1]])
        assert values[i, k] == own.min() and values[i, 200 + k] == own.max()
    a, b = set(h[at[0] : at[1]].tolist()), set(h[at[1] : at[2]].tolist())
    assert abs((values[0] == values[1]).mean() - len(a & b) / len(a | b)) < 0.06
    assert hashing.band_hashes(values).shape == (3, 80) and len(np.unique(hashing.band_hashes(values)[0])) == 80
