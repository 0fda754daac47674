"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of a text are cut into bins.  Training goes round the features: each step fits a shallow
tree on the bins of one feature to the current residuals and adds a small part of it to that feature's
lookup table.  Then the pairs of features that explain most of what is left get tables of their own, fitted
by trees of one cut per axis.  A score is the sum of the looked-up values under the logistic function.

Training uses at most ``SAMPLE`` labelled documents (those with the least hash of their id, a documented
bound); scoring covers all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh

SAMPLE = 20_000
BINS = 48
COARSE = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.08
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "bars_per_word", "digits", "capitals", "stops_per_word", "commas_per_word",
    "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "words_per_line", "beyond_ascii", "short_lines",
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>@^~=_\\{}[]|+")] = True


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES``; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log2(n + 1)),
        sum(map(len, words)) / n,
        float(count[_SYMBOLS].sum()) / n,
        float(count[124]) / n,
        float(count[48:58].sum()) / size,
        float(count[65:91].sum()) / size,
        float(count[[33, 46, 63]].sum()) / n,
        float(count[44]) / n,
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        float(count[128:].sum()) / size,
        sum(len(x) < 24 for x in lines) / len(lines),
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, by adding up bins."""
        if not len(x):
            return np.array([])
        total = np.full(len(x), self.start)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin borders at quantiles of the distinct values' ranks and of the rows, so that rare values have bins too."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.array([])
    half = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    return np.unique(np.concatenate([np.quantile(values, half), np.quantile(distinct, half)]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The value per bin of a tree with so many leaves on the bins' residual sums."""
    parts = [(0, len(g))]
    upto_g, upto_h = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    total = lambda a, b: (upto_g[b] - upto_g[a], upto_h[b] - upto_h[a])
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            at = np.arange(a + 1, b)
            if len(at):
                won = _gain(*total(a, at)) + _gain(*total(at, b)) - _gain(*total(a, b))
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        (a, b), k = best[1], best[2]
        parts = [p for p in parts if p != (a, b)] + [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        sg, sh = total(a, b)
        out[a:b] = sg / (sh + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table): a cut on the first axis, then one on the second in each half."""
    best, out = 0.0, np.zeros_like(g)
    for k in range(1, g.shape[0]):
        halves = [_tree(g[s].sum(axis=0), h[s].sum(axis=0), 2) for s in (slice(0, k), slice(k, None))]
        table = np.concatenate([np.tile(halves[0], (k, 1)), np.tile(halves[1], (g.shape[0] - k, 1))])
        won = float((2 * g * table - (h + 1.0 / g.size) * table * table).sum())
        if won > best:
            best, out = won, table
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """``y`` holds 0 and 1; without rows of both the model is a constant."""
    width = len(FEATURES)
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    none = [np.array([])] * width
    if len(set(y.tolist())) < 2:
        return Model(none, [np.zeros(1)] * width, [], none, [], start)
    cuts, coarse = [_cuts(x[:, f], BINS) for f in range(width)], [_cuts(x[:, f], COARSE) for f in range(width)]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), start)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = residual()
            step = RATE * _tree(*(np.bincount(bins[f], v, len(tables[f])) for v in (g, h)))
            tables[f] += step
            total += step[bins[f]]
    cell = lambda f, g, v: np.bincount(rough[f] * (len(coarse[g]) + 1) + rough[g], v, (len(coarse[f]) + 1) * (len(coarse[g]) + 1)).reshape(len(coarse[f]) + 1, -1)
    g, h = residual()
    gains = sorted(((-_pair_tree(cell(a, b, g), cell(a, b, h))[0], a, b) for a, b in combinations(range(width), 2)))
    pairs = [(a, b) for won, a, b in gains[:PAIRS] if won < 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            g, h = residual()
            step = RATE * _pair_tree(cell(a, b, g), cell(a, b, h))[1]
            table += step
            total += step[rough[a], rough[b]]
    return Model(cuts, tables, pairs, coarse, pair_tables, start)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled documents, in the order of their ids.

    ``labels`` has doc_id and label; rows with a null are left out, an id with several labels counts as the
    least, and so does an id that several documents share with the features of their texts."""
    chosen = (
        labels.filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most ``sample`` rows of two numbers
    table = append_columns(joined, ["text"], [("x", T.ArrayType(T.DoubleType()))], lambda texts: [[features(t) for t in texts]])
    rows = sorted(table.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect(), key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], float)


def scored(df: DataFrame, text: str, model: Model, threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (underscores in front where taken).

    Null texts score as empty ones.  Equal texts have equal scores; whole texts are read, however long.  An empty
    table gives an empty result."""
    score, predicted = fresh(df, "score", "predicted")

    def run(texts: list[str | None]) -> list[np.ndarray]:
        values = model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
        return [values, (values >= threshold).astype(np.int32)]

    return append_columns(df, [text], [(score, T.DoubleType()), (predicted, T.IntegerType())], run)
