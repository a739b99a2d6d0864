"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is a vector of the word itself, where training texts hold it often
enough, beside the mean of the vectors of its character trigrams. Two recurrent
layers read a window of WINDOW words, one from each end; attention weighs what
they give at each word, and the weighted sum gives the window's logit. Windows
overlap by half their length, so any run of words up to that stands whole in one
of them. All windows of a text are scored and the highest decides.

Labels are of whole texts, while a few words make a text toxic. Training begins
with random windows of each text and goes on with the windows that the network
itself finds highest, of toxic texts and of others. It is numpy on the driver
over a bounded sample of labelled texts; scoring is numpy in Spark's tasks, many
windows at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .collocations import Words
from .common import small_batches, whole, written
from .quality_gam import held_out
from .shingles import mix

#: Labelled texts to learn from, and their characters, at most.
MAX_ROWS, MAX_CHARS = 6000, 16_000_000
#: Words of a window, and from one window's start to the next one's.
WINDOW, STEP = 48, 24
#: Sizes of the vectors of words and trigrams, of each layer, and of attention.
WORD, CHARS, HIDDEN, ATTEND = 12, 12, 12, 8
#: Rows for trigrams, which are hashed, and texts that hold a word with a vector.
TRIGRAMS, HELD = 8192, 4
#: Bytes of text, and windows, that are looked at together.
STRETCH, TOGETHER = 1 << 20, 1024

_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
_FOLD[48:58] = range(48, 58)
_FOLD[97:123] = range(97, 123)
_FOLD[65:91] = range(97, 123)
_FOLD = bytes(_FOLD)


def plain(text: str) -> bytes:
    """A text's words, runs of ASCII letters (lower-cased), digits and characters
    beyond ASCII, with single blanks between them."""
    return b" ".join(text.encode().translate(_FOLD).split())


def trigrams(w: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first row of each word) of the trigrams of chosen words, one around
    each byte; a word's ends count as characters of their own."""
    size = (w.stop - w.start)[chosen]
    first = np.cumsum(size) - size
    at = np.repeat(w.start[chosen] - first, size) + np.arange(size.sum())
    raw = np.frombuffer(w.raw, np.uint8)
    before, here, after = (raw[at + k].astype(np.uint64) for k in (-1, 0, 1))
    before[first], after[first + size - 1] = 1, 2
    key = mix(before + (here << np.uint64(8)) + (after << np.uint64(16)))
    return (key % np.uint64(TRIGRAMS)).astype(np.int64), first


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, words) of all windows of texts of so many words."""
    n = np.maximum(1, -(-(counts - (WINDOW - STEP)) // STEP))
    text = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return text, first, np.minimum(WINDOW, counts[text] - first)


# --- the network ------------------------------------------------------------


class Net(NamedTuple):
    """Weights, all of 32-bit floats; a leading 2 is one for each direction."""

    word: np.ndarray  # (words + 1, WORD), row 0 for words without a vector
    char: np.ndarray  # (TRIGRAMS, CHARS)
    into: np.ndarray  # (2, WORD + CHARS, 3 HIDDEN): gates r, z and the candidate
    base: np.ndarray  # (2, 1, 3 HIDDEN)
    back: np.ndarray  # (2, HIDDEN, 3 HIDDEN)
    look: np.ndarray  # (2 HIDDEN, ATTEND)
    pick: np.ndarray  # (ATTEND,)
    out: np.ndarray  # (2 HIDDEN,)
    bias: np.ndarray  # (1,)


def fresh_net(n_words: int, g: np.random.Generator, positive: float) -> Net:
    def drawn(*shape, by):
        return (g.standard_normal(shape) * by).astype(np.float32)

    h = HIDDEN
    return Net(
        drawn(n_words + 1, WORD, by=0.1),
        drawn(TRIGRAMS, CHARS, by=0.3),
        drawn(2, WORD + CHARS, 3 * h, by=(WORD + CHARS) ** -0.5),
        np.zeros((2, 1, 3 * h), np.float32),
        drawn(2, h, 3 * h, by=h**-0.5),
        drawn(2 * h, ATTEND, by=(2 * h) ** -0.5),
        drawn(ATTEND, by=1.0),
        drawn(2 * h, by=0.3),
        np.array([np.log(positive / (1 - positive))], np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def inputs(net: Net, known: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The input vectors of words: their rows in net.word, their trigrams."""
    size = np.diff(np.append(first, len(rows)))[:, None].astype(np.float32)
    chars = np.add.reduceat(net.char[rows], first, axis=0) / size if len(first) else np.zeros((0, CHARS), np.float32)
    return np.concatenate([net.word[known], chars], 1)


def forward(net: Net, gates: np.ndarray, at: np.ndarray, here: np.ndarray, keep: bool = False):
    """Logits of windows. gates: (2, words, 3 HIDDEN), the words' inputs to the
    gates; at: (steps, windows), words; here: the same shape, 1 where there is one."""
    steps, n, h = *at.shape, HIDDEN
    both = np.zeros((steps, n, 2 * h), np.float32)
    state = np.zeros((2, n, h), np.float32)
    trace = []
    for t in range(steps):
        other = steps - 1 - t
        x = np.stack([gates[0][at[t]], gates[1][at[other]]])
        m = np.stack([here[t], here[other]])[:, :, None]
        u = state @ net.back
        rz = _sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
        r, z = rz[:, :, :h], rz[:, :, h:]
        c = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
        new = state + m * (1 - z) * (c - state)
        if keep:
            trace.append((state, u[:, :, 2 * h :], r, z, c, m))
        state = new
        both[t, :, :h] = state[0]
        both[other, :, h:] = state[1]
    seen = np.tanh(both @ net.look)
    weight = seen @ net.pick
    weight = np.exp(weight - weight.max(0)) * here
    weight /= np.maximum(weight.sum(0), 1e-20)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    logit = pooled @ net.out + net.bias[0]
    return (logit, (both, seen, weight, pooled, trace)) if keep else logit


def backward(net: Net, at, here, kept, slope: np.ndarray, n_words: int):
    """Gradients of the weights behind the gates, and of the gates' inputs, for a
    loss whose slope by each window's logit is given."""
    both, seen, weight, pooled, trace = kept
    steps, n, h = *at.shape, HIDDEN
    d_pooled = slope[:, None] * net.out
    d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_seen = d_score[:, :, None] * net.pick * (1 - seen * seen)
    d_both = weight[:, :, None] * d_pooled + d_seen @ net.look.T
    grads = {
        "out": pooled.T @ slope,
        "bias": np.array([slope.sum()]),
        "pick": np.einsum("tb,tba->a", d_score, seen),
        "look": np.einsum("tbh,tba->ha", both, d_seen, optimize=True),
    }
    d_back = np.zeros_like(net.back)
    d_gates = np.zeros((2, n_words, 3 * h), np.float32)
    d_state = np.zeros((2, n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        other = steps - 1 - t
        state, u, r, z, c, m = trace[t]
        d_new = d_state + np.stack([d_both[t, :, :h], d_both[other, :, h:]])
        d_c = d_new * m * (1 - z) * (1 - c * c)
        d_r = d_c * u * r * (1 - r)
        d_z = -d_new * m * (c - state) * z * (1 - z)
        d_u = np.concatenate([d_r, d_z, d_c * r], 2)
        d_x = np.concatenate([d_r, d_z, d_c], 2)
        d_state = d_new * (1 - m * (1 - z)) + d_u @ net.back.transpose(0, 2, 1)
        d_back += state.transpose(0, 2, 1) @ d_u
        np.add.at(d_gates[0], at[t], d_x[0])
        np.add.at(d_gates[1], at[other], d_x[1])
    grads["back"] = d_back
    return grads, d_gates


class Model(NamedTuple):
    hashes: np.ndarray
    """Sorted hashes of the words with vectors; a word's row is its place and one."""
    net: Net
    slope: float
    """The score is the logistic function of slope times the highest logit, plus"""
    shift: float

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logit, text, first word, words) of all windows of plain texts."""
        counts = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        gates, word = np.zeros((2, 1, 3 * HIDDEN), np.float32), np.zeros(1, np.int64)
        begin = np.zeros(len(texts), np.int64)
        if full:
            w = Words([texts[i] for i in full])
            counts[full], begin[full] = w.count, w.last - w.count
            _, chosen, word = np.unique(w.hashes[0], return_index=True, return_inverse=True)
            x = inputs(self.net, self.rows_of(w.hashes[0][chosen]), *trigrams(w, chosen))
            gates = x @ self.net.into + self.net.base
        text, first, size = windows(counts)
        logit = np.zeros(len(text), np.float32)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            step = np.arange(max(1, size[some].max()))[:, None]
            here = step < size[some]
            at = np.where(here, begin[text[some]] + first[some] + step, 0)
            logit[some] = forward(self.net, gates, word[at], here.astype(np.float32))
        return logit, text, first, size

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit.astype(float) + self.shift)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each plain text."""
        best = np.full(len(texts), -np.inf, np.float32)
        for a, b in _stretches(texts):
            logit, text, _, _ = self.logits(texts[a:b])
            np.maximum.at(best[a:b], text, logit)
        return self.score(best)


def _stretches(texts: list[bytes]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= STRETCH):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class _Adam:
    def __init__(self, net: Net, rate: float):
        self.rate, self.n = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in net._asdict().items()}
        self.square = {k: np.zeros_like(v) for k, v in net._asdict().items()}

    def step(self, net: Net, grads: dict) -> None:
        self.n += 1
        by = self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for k, g in grads.items():
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            getattr(net, k)[...] -= by * m / (np.sqrt(s) + 1e-7)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y to x, kept near (1, 0)."""
    v = np.array([1.0, 0.0])
    a = np.stack([x.astype(float), np.ones(len(x))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        grad = a.T @ (p - y) + 0.5 * (v - [1.0, 0.0])
        v = v - np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + 0.5 * np.eye(2), grad)
    return float(max(v[0], 1e-3)), float(v[1])


def fit(
    texts: list[bytes],
    y: np.ndarray,
    rounds: int = 7,
    batch: int = 192,
    rate: float = 0.006,
    forget: float = 0.5,
    seed: int = 1,
) -> Model:
    """A model of 0/1 labels y of plain texts; words are forgotten at random (their
    trigrams stay) so that the network reads characters too. Without both labels
    every score is the share of ones."""
    g = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    full = [i for i, t in enumerate(texts) if t]
    hashes, known, word = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    counts, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if full:
        w = Words([texts[i] for i in full])
        counts[full], begin[full] = w.count, w.last - w.count
        distinct, chosen, word = np.unique(w.hashes[0], return_index=True, return_inverse=True)
        pairs = np.unique(word * len(texts) + w.text)
        often = np.bincount(pairs // len(texts), minlength=len(distinct)) >= HELD
        hashes = distinct[often]
        known = np.where(often, np.cumsum(often), 0)
        rows, first_row = trigrams(w, chosen)
        sizes = np.diff(np.append(first_row, len(rows)))
        del w
    model = Model(hashes, fresh_net(len(hashes), g, share), 1.0, 0.0)
    if not full or not 0 < y.sum() < len(y):
        model.net.out[:] = 0
        return model
    net, adam = model.net, _Adam(model.net, rate)
    text, first, size = windows(counts)
    places = np.cumsum(np.bincount(text, minlength=len(texts)))
    n_windows = np.diff(places, prepend=0)

    def learn(some: np.ndarray) -> None:
        step = np.arange(max(1, size[some].max()))[:, None]
        here = step < size[some]
        at = word[np.where(here, begin[text[some]] + first[some] + step, 0)]
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(here.shape)
        n = sizes[used]
        start = np.cumsum(n) - n
        tri = rows[np.repeat(first_row[used] - start, n) + np.arange(n.sum())]
        row = np.where(g.random(len(used)) < forget, 0, known[used])
        x = inputs(net, row, tri, start)
        here = here.astype(np.float32)
        logit, kept = forward(net, x @ net.into + net.base, at, here, keep=True)
        slope = ((_sigmoid(logit) - y[text[some]]) / len(some)).astype(np.float32)
        grads, d_gates = backward(net, at, here, kept, slope, len(used))
        grads["into"] = x.T @ d_gates
        grads["base"] = d_gates.sum(1, keepdims=True)
        d_x = (d_gates @ net.into.transpose(0, 2, 1)).sum(0)
        d_word, d_char = np.zeros_like(net.word), np.zeros_like(net.char)
        np.add.at(d_word, row, d_x[:, :WORD])
        np.add.at(d_char, tri, np.repeat(d_x[:, WORD:] / n[:, None], n, 0))
        grads["word"] = d_word + 1e-4 * net.word
        grads["char"] = d_char + 1e-5 * net.char
        adam.step(net, grads)

    def highest() -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows, and the place of each text's highest."""
        logit = np.concatenate([model.logits(texts[a:b])[0] for a, b in _stretches(texts)])
        order = np.lexsort((logit, text))
        return logit, order[places - 1]

    for turn in range(rounds):
        adam.rate = rate * (1 - 0.8 * turn / rounds)
        drawn = places - 1 - (g.random(len(texts)) * n_windows).astype(np.int64)
        if turn < 2:
            more = places - 1 - (g.random((4, len(texts))) * n_windows).astype(np.int64)
            some = np.concatenate([drawn, more[:, y == 1].ravel()])
        else:
            _, top = highest()
            some = np.concatenate([top, drawn[y == 0], top[y == 1]])
        for _ in range(1 if len(some) > 4000 else 3):
            some = g.permutation(some)
            for a in range(0, len(some), batch):
                learn(some[a : a + batch])
    logit, top = highest()
    slope, shift = _calibrated(logit[top], y)
    return model._replace(slope=slope, shift=shift)


# --- Spark ------------------------------------------------------------------


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    parts: int = 4,
    part: int = 2,
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
    **fit_options,
) -> Model:
    """A model of label_col from labelled documents that are not held out.

    Of these, max_rows at most are read, in the order of a hash of their ids and
    texts, and of those the ones that fit into max_chars characters in all, each
    whole. Defined cases: labels that are null, or whose id is null or has no
    document, are ignored; rows that repeat id, text and label teach once; a null
    text is an empty one; other columns are ignored; without both labels, or on
    empty tables, all scores are equal.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(~held_out(id_col, parts, part) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(max_rows)
    )
    rows = written(
        docs.select(F.col(id_col).alias("_doc"), whole(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select(F.xxhash64("_doc", "text", "y").alias("key"), F.char_length("text").alias("size"), "y", "text"),
        "toxicity-rows",
    )
    keys, held = [], 0
    for r in rows.select("key", "size").distinct().orderBy("key").limit(max_rows).collect():
        if held + r["size"] <= max_chars:
            keys.append((r["key"],))
            held += r["size"]
    taken = docs.sparkSession.createDataFrame(keys, "key long")
    found = rows.join(F.broadcast(taken), "key").dropDuplicates(["key"]).select("key", "y", "text").collect()
    found.sort()
    return fit([plain(r["text"]) for r in found], np.array([r["y"] for r in found]), **fit_options)


def _unpacked(sent) -> Model:
    hashes, net, slope, shift = sent
    return Model(hashes, Net(*net), slope, shift)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, 0 to 1, from the text alone.

    Defined cases: a null or empty text, or one without a word, has one empty
    window and its score; texts are of any length and read whole; equal texts
    have equal scores whatever their ids; an empty table stays empty; a column
    called score_col is replaced, all others pass.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, tuple(model.net), model.slope, model.shift))

    @F.pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(_unpacked(sent.value).scores([plain(t) for t in text]))

    return docs.withColumn(score_col, score(whole(text_col)))


def passages(
    docs: DataFrame, model: Model, at_least: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, first_word, words, score, passage: the windows that score at_least
    or more, as lower-cased words; cases as in scored()."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, tuple(model.net), model.slope, model.shift))

    def found(batches):
        m = _unpacked(sent.value)
        for b in batches:
            texts = [plain(t.as_py()) for t in b.column(1)]
            for s, e in _stretches(texts):
                logit, text, first, size = m.logits(texts[s:e])
                score = m.score(logit)
                hit = np.flatnonzero(score >= at_least)
                words = {i: texts[s + i].split(b" ") for i in set(text[hit].tolist())}
                cut = [b" ".join(words[text[i]][first[i] : first[i] + size[i]]).decode() for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(s + text[hit])),
                        pa.array(first[hit], pa.int64()),
                        pa.array(size[hit], pa.int64()),
                        pa.array(score[hit], pa.float64()),
                        pa.array(cut, pa.string()),
                    ],
                    names=["id", "first_word", "words", "score", "passage"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    out = rows.mapInArrow(found, f"id {id_type}, first_word long, words long, score double, passage string")
    return out.withColumnRenamed("id", id_col)
