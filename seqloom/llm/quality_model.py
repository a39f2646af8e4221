"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature gets one shallow tree over its bins, fitted to the gradient of the
logistic loss and added to the feature's lookup table at a small rate. The pairs that explain most of what is left
then get tables of their own in the same way. A score is the sum of looked-up values, one per feature and pair.

The model is trained on the driver on at most ``max_rows`` labelled documents, those with the smallest hashes of
their ids; features of the other rows never leave the executors. Only the text is an input.

Defined results: a null text is empty and gets a score like any other. Rows without a label, with labels other
than 0 and 1, or held out are not learned from; without any, the score is 0.5, with one class only it is that
class's. Of rows that share a doc_id the smallest text is learned from, of its labels the largest. Repeated rows get equal
scores; texts of any length are measured whole; an empty table gives an empty result. Input columns named like a
result column are replaced, columns of other names pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import map_rows, map_text

FEATURES = (
    "log_words", "word_length", "distinct", "adjacent", "top_word", "upper", "symbols", "marks", "pipes", "digits", "commas",
    "repeated_lines", "line_length", "entropy",
)
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 8, 150, 0.15


def measure(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, size, m = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = size - counts[:65].sum()
    share = counts[counts > 0] / size
    seen = Counter(words)
    most = max(seen.values(), default=0)
    return (
        float(np.log1p(len(words))), (size - counts[9:14].sum() - counts[32]) / n, len(seen) / n, sum(map(eq, words, words[1:])) / n, most / n,
        counts[65:91].sum() / max(1, letters), (counts[[35, 36, 37, 38, 42, 60, 62]].sum()) / n, (counts[33] + counts[63]) / n, counts[124] / n,
        counts[48:58].sum() / n, (counts[44] + counts[46]) / n, 1 - len(set(lines)) / m if lines else 0.0, float(np.log1p(size / m)),
        float(-(share * np.log(share)).sum()),
    )


@dataclass
class Model:
    """edges: inner bin edges of each feature; tables: values by bin; pair tables over coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], "right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.coarse)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[bins[i], bins[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with a few leaves over ordered bins; every split is the best of all leaves."""
    cuts = [0, len(gradient)]
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def gain(a: int, b: int) -> float:
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)

    while len(cuts) <= leaves:
        best = max(
            ((gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + 1, b)),
            default=(0, 0),
        )
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over a grid: the best first cut of either axis, then one cut of the other in each half."""
    best, out = -1.0, np.zeros_like(gradient)
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for c in range(1, len(g)):
            halves = [_tree(g[part].sum(axis=0), w[part].sum(axis=0), 2) for part in (slice(0, c), slice(c, None))]
            sums = [g[part].sum(axis=0) for part in (slice(0, c), slice(c, None))]
            value = sum(float((h * s).sum()) for h, s in zip(halves, sums, strict=True))
            if value > best:
                best = value
                grid = np.vstack([np.tile(halves[0], (c, 1)), np.tile(halves[1], (len(g) - c, 1))])
                out = grid if axis == 0 else grid.T
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Fit the tables. x: rows of FEATURES, y: 0 or 1."""
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else 30.0 * (1 if y[0] else -1)
        none = [np.zeros(0) for _ in range(k)]
        return Model(base, none, [np.zeros(1) for _ in range(k)], none, [], [])
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    edges = [_edges(x[:, i], BINS) for i in range(k)]
    coarse = [_edges(x[:, i], PAIR_BINS) for i in range(k)]
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(len(y), base)

    def steps() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i in range(k):
            g, w = steps()
            n = len(tables[i])
            step = rate * np.clip(_tree(np.bincount(bins[i], g, n), np.bincount(bins[i], w, n)), -4, 4)
            tables[i] += step
            logit = logit + step[bins[i]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[i] * b + wide[j], values, a * b).reshape(a, b)

    g, w = steps()
    gains = []
    for i, j in combinations(range(k), 2):
        a, b = grid(i, j, g), grid(i, j, w)
        gains.append((float((a * a / (b + 1)).sum()), i, j))
    pairs = [(i, j) for _, i, j in sorted(gains, key=lambda p: (-p[0], p[1:]))[:PAIRS]]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(rounds // 5):
        for p, (i, j) in enumerate(pairs):
            g, w = steps()
            step = rate * np.clip(_grid_tree(grid(i, j, g), grid(i, j, w)), -4, 4)
            grids[p] += step
            logit = logit + step[wide[i], wide[j]]
    return Model(base, edges, tables, coarse, pairs, grids)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def labelled_features(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, text: str = "text") -> DataFrame:
    """Features and label of at most max_rows labelled documents, as columns x and y."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    return map_text(rows, lambda: lambda t: (list(map(float, measure(t))),), [field], "text").select("x", "y")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    rows = labelled_features(docs, labels, **options).collect()
    rows.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r.y for r in rows], float))


def auc(scored: DataFrame, labels: DataFrame, label: str = "quality") -> float:
    """Of held-out labelled rows, how often one of label 1 scores over one of label 0 (ties count half). Scores are counted by value first."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = scored.filter(held_out(F.col("doc_id"))).join(known, "doc_id").groupBy(F.round("score", 4).alias("s")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    wins = below = positives = 0.0
    for r in rows.orderBy("s").collect():
        wins += r.p * (below + r.q / 2)
        below, positives = below + r.q, positives + r.p
    return wins / (below * positives) if below and positives else 0.5


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Add score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shared.value

        def many(texts: Sequence[str | None]) -> list:
            x = np.array([measure(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            s = model.scores(x)
            return [s, (s >= threshold).astype(np.int32)]

        return many

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_rows(docs, factory, fields, text)
