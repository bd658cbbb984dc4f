"""A quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned. Boosting goes round the features in turn; each time, a
shallow tree on one feature's bins is fitted to the gradient of the logistic loss and added, shrunk,
to that feature's lookup table. Then the pairs with the greatest gain get two-dimensional tables in
the same way. A score is the logistic function of the sum of the bins' entries, taken for a whole
batch at once.

The model is fitted on the driver on the features of ``TRAIN_ROWS`` labelled rows at most, those
with the smallest hashes of their ids, so that its size doesn't grow with the corpus; every document
is scored.

Nulls: a null text counts as empty, which has features and a score as any text; labels that are null
are not learnt from; of several labels of an id the greatest counts. Very long texts: whole. Repeated
rows: each is scored. Empty tables: empty result; without labels, or with labels of one class alone,
every score is the share of label 1 (0.5 without labels). Other columns pass through; names given
here replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import with_columns
from stemma.llm.segments import slices

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 32, 8, 60, 20, 6, 0.15, 4
THRESHOLD = 0.3

FEATURES = ("log_words", "word_bytes", "capitals", "digits", "symbols", "shouts", "stops", "lines", "distinct", "neighbours", "repeated_lines", "high_bytes", "longest")


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        words = text.split()
        lines = text.split("\n")
        n, size = max(1, len(words)), len(raw)
        count = lambda chars: size - len(raw.translate(None, chars))  # noqa: B023, E731
        out[i] = (
            np.log1p(len(words)),
            (size - count(b" \t\n\r\x0b\x0c")) / n,
            count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
            count(b"0123456789") / size,
            count(b"#*$%&|<>{}[]\\^~=") / n,
            count(b"!?") / n,
            count(b".,;:") / n,
            len(lines) / n,
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines),
            (size - len(text)) / size,
            min(200, max(map(len, words), default=0)),
        )
    return out


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step for each bin: the leaf values of a tree with ``leaves`` leaves, the best split first."""
    edges = [0, len(g)]

    def best(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0.0, a
        left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
        gain = left + right - gs[-1] ** 2 / (hs[-1] + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    found = {(0, len(g)): best(0, len(g))}
    while len(edges) <= leaves:
        (a, b), (gain, cut) = max(found.items(), key=lambda x: x[1][0])
        if gain <= 1e-9:
            break
        del found[a, b]
        found[a, cut], found[cut, b] = best(a, cut), best(cut, b)
        edges.append(cut)
    step = np.zeros(len(g))
    for a, b in found:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the steps of a tree that cuts one axis, then each side on the other."""
    top, table = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + 1)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            steps, gain = np.zeros_like(gg), -total
            for part in (slice(0, cut), slice(cut, None)):
                step = _tree(gg[part].sum(0), hh[part].sum(0), 2)
                steps[part] = step
                gain += float((step * gg[part].sum(0)).sum())
            if gain > top:
                top, table = gain, steps.T if turned else steps
    return top, table


@dataclass
class Model:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):  # none, if there was nothing to learn
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features ``x`` and labels ``y`` (0 or 1); the same for the same rows in any order."""
    y = np.asarray(y, float)
    if len(y):
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    m = Model(bias, [], [], [], [])
    if not len(y) or not 0 < share < 1:
        return m
    d = x.shape[1]
    m.cuts, m.pair_cuts = [_cuts(x[:, j], BINS) for j in range(d)], [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    at = [np.searchsorted(m.cuts[j], x[:, j], "right") for j in range(d)]
    m.tables = [np.zeros(len(m.cuts[j]) + 1) for j in range(d)]
    total = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(m.tables[j])
            step = RATE * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), LEAVES)
            m.tables[j] += step
            total += step[at[j]]
    pair_at = [np.searchsorted(m.pair_cuts[j], x[:, j], "right") for j in range(d)]
    sizes = [len(c) + 1 for c in m.pair_cuts]

    def pair_slopes(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = pair_at[a] * sizes[b] + pair_at[b]
        return tuple(np.bincount(cell, v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in (g, h))

    g, h = slopes()
    gains = sorted(((-_pair_tree(*pair_slopes(a, b, g, h))[0], a, b) for a in range(d) for b in range(a + 1, d)))
    m.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in gains[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in m.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(*pair_slopes(a, b, g, h))[1]
            table += step
            total += step[pair_at[a], pair_at[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``rows`` labelled documents at most. ``labels`` must hold no row that is kept for tests."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most ``rows`` rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("label")], names=[*FEATURES, "label"])

    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in (*FEATURES, "label")])
    found = texts.mapInArrow(run, schema).limit(rows).toPandas()
    return fit(found[list(FEATURES)].to_numpy(float), found["label"].to_numpy(float))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from THRESHOLD)."""

    def run(texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for at, rows in slices(texts):
            s = model.score(features(texts.slice(at, rows).to_pylist()))
            yield {"score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))}

    return with_columns(df, text_col, run, "score double, predicted int")
