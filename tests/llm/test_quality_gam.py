"""The additive model against plain loops: scores from the tables, and training itself."""

import math
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pytest

from textscan.llm import quality_gam as G


def plain_score(model, row):
    total = model.start
    for f in range(len(row)):
        total += model.tables[f][bisect_right(list(model.cuts[f]), row[f])]
    for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[bisect_right(list(model.coarse[f]), row[f])][bisect_right(list(model.coarse[g]), row[g])]
    return 1 / (1 + math.exp(-total))


def plain_tree(g, h, leaves=3):
    parts = [(0, len(g))]
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            for k in range(a + 1, b):
                won = gain(a, k) + gain(k, b) - gain(a, b)
                if won > best[0]:
                    best = (won, (a, b), k)
        if best[1] is None:
            break
        (a, b), k = best[1:]
        parts = [p for p in parts if p != (a, b)] + [(a, k), (k, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def plain_pair_tree(g, h):
    rows, columns = len(g), len(g[0])
    best, out = 0.0, [[0.0] * columns for _ in range(rows)]
    for k in range(1, rows):
        table = []
        for low, high in ((0, k), (k, rows)):
            half = plain_tree([sum(g[i][j] for i in range(low, high)) for j in range(columns)], [sum(h[i][j] for i in range(low, high)) for j in range(columns)], 2)
            table += [half] * (high - low)
        won = sum(2 * g[i][j] * table[i][j] - (h[i][j] + 1 / (rows * columns)) * table[i][j] ** 2 for i in range(rows) for j in range(columns))
        if won > best:
            best, out = won, table
    return best, out


def plain_train(x, y, cuts, coarse):
    """The scores' logits after cyclic boosting of features, then of the best pairs, row by row."""
    rate = (sum(y) + 1) / (len(y) + 2)
    total = [math.log(rate / (1 - rate))] * len(y)
    bin_of = [[bisect_right(cuts[f], r[f]) for r in x] for f in range(len(cuts))]
    rough = [[bisect_right(coarse[f], r[f]) for r in x] for f in range(len(cuts))]

    def residuals():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    for _ in range(G.ROUNDS):
        for f in range(len(cuts)):
            g, h = residuals()
            n = len(cuts[f]) + 1
            tree = plain_tree([sum(v for v, b in zip(g, bin_of[f], strict=True) if b == k) for k in range(n)], [sum(v for v, b in zip(h, bin_of[f], strict=True) if b == k) for k in range(n)])
            total = [t + G.RATE * tree[b] for t, b in zip(total, bin_of[f], strict=True)]

    def cells(a, b, values):
        out = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
        for v, i, j in zip(values, rough[a], rough[b], strict=True):
            out[i][j] += v
        return out

    g, h = residuals()
    gains = sorted((-plain_pair_tree(cells(a, b, g), cells(a, b, h))[0], a, b) for a, b in combinations(range(len(cuts)), 2))
    pairs = [(a, b) for won, a, b in gains[: G.PAIRS] if won < 0]
    for _ in range(G.PAIR_ROUNDS):
        for a, b in pairs:
            g, h = residuals()
            table = plain_pair_tree(cells(a, b, g), cells(a, b, h))[1]
            total = [t + G.RATE * table[i][j] for t, i, j in zip(total, rough[a], rough[b], strict=True)]
    return pairs, [1 / (1 + math.exp(-t)) for t in total]


@pytest.fixture
def model_and_rows(monkeypatch):
    monkeypatch.setattr(G, "ROUNDS", 12)
    monkeypatch.setattr(G, "PAIR_ROUNDS", 5)
    rng = np.random.default_rng(3)
    x = np.zeros((80, len(G.FEATURES)))
    x[:, 2], x[:, 5], x[:, 9] = rng.normal(size=80), rng.integers(0, 6, 80), rng.exponential(size=80)
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 2) | (x[:, 9] > 2)).astype(float)
    return G.train(x, y), x, y


def test_scores_are_sums_of_looked_up_values(model_and_rows):
    model, x, _ = model_and_rows
    assert model.score(x) == pytest.approx([plain_score(model, r) for r in x])


def test_training_is_cyclic_boosting(model_and_rows):
    model, x, y = model_and_rows
    pairs, scores = plain_train(x.tolist(), y.tolist(), [list(c) for c in model.cuts], [list(c) for c in model.coarse])
    assert pairs == model.pairs and (2, 5) in pairs
    assert model.score(x) == pytest.approx(scores, abs=1e-9)
