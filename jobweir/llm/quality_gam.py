"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and a few pairs of features have
a table over the grid of theirs. Cyclic boosting learns them: round after
round, each table in turn gets a small tree (three leaves for a feature, four
for a pair) fitted to the current gradients, at a low learning rate. A score is
the sum of the looked-up values, so scoring is binning and adding, for whole
Arrow batches at once.

Training sees at most ``max_rows`` labelled documents, chosen by a hash of
their id; a model has some thousand numbers. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .common import fresh, lean, small_batches, whole

MAX_ROWS = 20_000

FEATURES = (
    "chars words word_length upper digits punctuation marks symbols bars other_bytes distinct_words "
    "commonest_word repeated_words shouted_words ends distinct_lines line_words capital_words"
).split()

_SETS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "punctuation": [*b".,;:'\"()-?"],
    "marks": [*b"!"],
    "symbols": [*b"#$%&*@^~_=+<>/\\{}[]`"],
    "bars": [*b"|"],
    "other_bytes": range(128, 256),
}
_MASKS = np.zeros((256, len(_SETS)))
for _i, _s in enumerate(_SETS.values()):
    _MASKS[list(_s), _i] = 1


def features(text: str) -> list[float]:
    """Shape of a text: shares of kinds of characters, words and lines."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = dict(zip(_SETS, (np.bincount(raw, minlength=256) @ _MASKS).tolist()))
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    letters = max(1.0, kinds["upper"] + kinds["lower"])
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        (len(text) - len(words)) / n,
        kinds["upper"] / letters,
        kinds["digits"] / size,
        kinds["punctuation"] / n,
        kinds["marks"] / n,
        kinds["symbols"] / n,
        kinds["bars"] / n,
        kinds["other_bytes"] / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in ".!?" for w in words) / n,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(map(str.istitle, words)) / n,
    ]


# --- the model --------------------------------------------------------------


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1: one binned lookup for each feature and pair, added."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = {
            j: np.searchsorted(self.pair_edges[j], x[:, j], "right")
            for j in {j for pair in self.pairs for j in pair}
        }
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, ridge: float):
    return g * g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, place) of the best cut of a run of bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge)
    at = int(np.argmax(gains))
    return float(gains[at] - _gain(g.sum(), h.sum(), ridge)), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of up to three leaves over a feature's bins; its value in each."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        gain, k, cut = max(
            ((lambda c: (c[0], i, c[1]))(_best_cut(g[a:b], h[a:b], ridge)) for i, (a, b) in enumerate(parts))
        )
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _corner_sums(m: np.ndarray) -> np.ndarray:
    """Sums of the four quarters around each inner grid point: shape (4, a-1, b-1)."""
    s = np.cumsum(np.cumsum(m, 0), 1)
    top, side, all_ = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
    a = s[:-1, :-1]
    return np.stack([a, top - a, side - a, all_ - top - side + a])


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts a pair's grid once on each axis."""
    out = np.zeros_like(g)
    if min(g.shape) < 2:
        return 0.0, out
    sg, sh = _corner_sums(g), _corner_sums(h)
    gains = _gain(sg, sh, ridge).sum(0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = -sg[:, i, j] / (sh[:, i, j] + ridge)
    i, j = i + 1, j + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return float(gains.max() - _gain(g.sum(), h.sum(), ridge)), out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    pair_bins: int = 8,
    n_pairs: int = 6,
    rounds: int = 200,
    pair_rounds: int = 100,
    rate: float = 0.1,
    ridge: float = 2.0,
) -> Model:
    """Cyclic boosting of the features' tables, then of the best pairs' tables."""
    width = x.shape[1]
    base = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(base / (1 - base)))
    edges = [_edges(x[:, j], bins) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [_edges(x[:, j], pair_bins) if len(x) else np.zeros(0) for j in range(width)]
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _tree(
                np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), ridge
            )
            tables[j] += step
            total += step[binned[j]]

    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(pair, v):
        i, j = pair
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * b + cells[j], v, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(
        ((i, j) for i in range(width) for j in range(i)),
        key=lambda p: -_quarters(grid(p, g), grid(p, h), ridge)[0],
    )
    pairs = ranked[:n_pairs] if len(y) else []
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes()
            step = rate * _quarters(grid((i, j), g), grid((i, j), h), ridge)[1]
            pair_tables[k] += step
            total += step[cells[i], cells[j]]
    return Model(intercept, edges, tables, coarse, pairs, pair_tables)


# --- Spark ------------------------------------------------------------------


def held_out(id_col: str | Column, parts: int = 3, part: int = 1) -> Column:
    """crc32 of the id as text leaves this remainder; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def _feature_rows(batches):
    for b in batches:
        x = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"]
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
    **fit_options,
) -> Model:
    """A model of label_col from the labelled documents that are not held out.

    Defined cases: labels that are null, or whose id is null or has no document,
    are ignored; a label or a document that repeats an id teaches once for each
    pair of rows; a null text is an empty one; other columns are ignored; without
    any label, or on empty tables, every score is 0.5. The chosen ids, max_rows
    at most, are sent to every task, so that no other text is moved.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_doc"), whole(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select("y", "text")
        .mapInArrow(lean(_feature_rows), "y double, x array<double>")
        .collect()
    )
    rows.sort()  # sums of floats then do not depend on the order of arrival
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows]), **fit_options)


def scored(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """docs with score_col, 0 to 1, from the text alone.

    Defined cases: a null text is scored as an empty one; every row is scored, so
    rows that repeat an id or a text have equal scores for equal texts; an empty
    table stays empty; a column called score_col is replaced, all others pass.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain: workers lack this package

    @F.pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text]).reshape(len(text), len(FEATURES))
        return pd.Series(Model(*sent.value).score(x))

    return docs.withColumn(score_col, score(whole(text_col)))


def keep_good(
    docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5
) -> DataFrame:
    """The rows of docs whose text scores at_least or more, columns unchanged;
    cases as in scored()."""
    name = fresh(docs, "score")
    return scored(docs, model, text_col, name).where(F.col(name) >= at_least).drop(name)
