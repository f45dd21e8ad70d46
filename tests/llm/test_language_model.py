"""The language machines against plain versions: trigram counts, the solver's optimum and the votes."""

import itertools
import math
import random
from collections import Counter

import numpy as np

from oddsmill.llm.language import DIMS, LanguageModel, features, fit_svm


def test_features_are_counts_of_trigrams_however_they_are_sliced():
    texts = ["", "ab", "Ünder the 12 Sea " * 50, "x" * 1000]
    for slice_bytes in (1, 7, 1 << 20):
        got = features(texts, slice_bytes)
        for text, row in zip(texts, got, strict=True):
            raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in f"  {text.lower()} ".encode()]
            want = np.zeros(DIMS)
            for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
                want[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
            want = np.sqrt(want)
            assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-5)


def test_the_solver_reaches_the_optimum_of_a_plain_one():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(120, 30))).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * r.normal(size=120) > 0.6, 1, -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    full, share = np.hstack([x, np.ones((120, 1))]), np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return w @ w / 20 + sum(s * max(0.0, 1 - t * float(v @ w)) ** 2 for s, t, v in zip(share, y, full, strict=True))

    w = np.zeros(31)
    for _ in range(20_000):  # plain descent
        slack = np.maximum(0, 1 - y * (full @ w))
        w -= 0.1 * (w / 10 - 2 * (share * y * slack) @ full)
    assert loss(fit_svm(x, y).astype(float)) <= loss(w) * 1.001 + 1e-6


def test_votes_equal_counting_by_hand():
    r = np.random.default_rng(5)
    langs = {"one": ["aa", "bb", "cc", "dd"], "two": ["ee"]}
    w = lambda: r.normal(size=DIMS + 1).astype(np.float32)
    model = LanguageModel(["one", "two"], np.array([w(), w()]), langs, {"one": [(a, b, w()) for a, b in itertools.combinations(langs["one"], 2)], "two": []})
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(80)) for _ in range(60)] + [None, "", "12 ½"]
    got, scores = model.predict(texts)
    assert got[-3:] == ["und"] * 3 and scores[-3:] == [0.0] * 3
    for text, lang, score in zip(texts[:-3], got, scores, strict=False):
        x = [float(v) for v in features([text])[0]]
        dot = lambda m, x=x: sum(a * float(b) for a, b in zip(x, m, strict=False)) + float(m[-1])
        margins = [dot(m) for m in model.family_w]
        family = model.families[margins.index(max(margins))]
        won, total = Counter({k: 0 for k in langs[family]}), Counter()
        for a, b, m in model.pairs[family]:
            d = dot(m)
            won[a if d >= 0 else b] += 1
            total[a if d >= 0 else b] += abs(d)
        want = max(langs[family], key=lambda k: (won[k], total[k], k))
        assert lang == want
        sure = 1 / (1 + math.exp(-2 * (max(margins) - min(margins))))
        assert abs(score - sure * (1 / (1 + math.exp(-4 * total[want] / won[want])) if won[want] else 1.0)) < 1e-3 and 0 <= score <= 1
