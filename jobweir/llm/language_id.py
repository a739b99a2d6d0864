"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its
text. A text is parsed against it greedily: each phrase is the longest match
that the automaton allows, then the next phrase starts. Text of the sample's
language needs few, long phrases; the language with the fewest phrases for a
character wins.

The automata are dense transition tables, so that many texts are parsed in
step: one table lookup moves thousands of parses by one character, for all
languages at once. Long texts are cut into stretches of STRETCH characters that
are parsed side by side; the whole text is always read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_batches, whole
from .quality_gam import held_out

#: Characters of sample text for each language, and documents they come from.
SAMPLE_CHARS = 20_000
SAMPLE_DOCS = 100
#: Languages, the most frequent ones, that are learned at most.
LANGUAGES = 256
STRETCH = 512
#: Letters whose transitions are dense tables; those of rarer letters are kept
#: sparse, as (state, symbol) keys, so that alphabets of any size keep all letters.
SYMBOLS = 62
#: More than the symbols there can be.
MANY = 1 << 21


class Model(NamedTuple):
    languages: list[str]
    letters: str
    """Symbol 0 is a letter that no sample holds, 1 a blank, then these."""
    next: np.ndarray
    """next[state + symbol] is the following state (a multiple of width), or -1.
    State 0 has no way out: after it, a phrase begins."""
    roots: np.ndarray
    width: int
    keys: np.ndarray
    """Sorted state * MANY + symbol of the transitions by symbols from width on,"""
    to: np.ndarray
    """and where they lead."""

    def follow(self, state: np.ndarray, s: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The states after symbols s (a column each), -1 without a transition;
        rare: the places of symbols from width on."""
        if not len(rare):
            return self.next[state + s].astype(np.int64)
        out = self.next[state + np.where(s < self.width, s, 0)].astype(np.int64)
        if len(self.keys):
            at_rare = np.broadcast_to(state, out.shape)[:, rare]
            wanted = at_rare // self.width * MANY + s[rare]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[:, rare] = np.where(self.keys[at] == wanted, self.to[at], -1)
        return out


def normalised(text: str) -> str:
    """Lower case; every run of other than letters is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Transitions of the automaton of all substrings: a table for symbols below
    width, -1 where there is none, and (state, symbol, next) for the others."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table, others = np.full((len(follow), width), -1, np.int32), []
    for s, row in enumerate(follow):
        for c, t in row.items():
            if c < width:
                table[s, c] = t
            else:
                others.append((s, c, t))
    return table, others


def build(samples: dict[str, str], symbols: int = SYMBOLS) -> Model:
    """A model from normalised sample text of each language.

    All samples are cut to the length of the shortest that has half of the
    median length or more, as longer samples would make longer matches.
    """
    samples = {k: v for k, v in sorted(samples.items()) if v}
    if not samples:
        none = np.zeros(0, np.int64)
        return Model([], "", np.full(1, -1, np.int32), none, 1, none, none)
    sizes = sorted(map(len, samples.values()))
    size = min(n for n in sizes if n >= sizes[len(sizes) // 2] / 2)
    samples = {k: v[:size] for k, v in samples.items()}
    counts: dict[str, int] = {}
    for v in samples.values():
        for c in v:
            counts[c] = counts.get(c, 0) + 1
    counts.pop(" ", None)
    letters = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
    width = min(len(letters), symbols) + 2
    code = {" ": 1} | {c: i + 2 for i, c in enumerate(letters)}
    tables, roots, at, sparse = [np.full((1, width), -1, np.int32)], [], 1, []
    for v in samples.values():
        t, others = suffix_automaton([code[c] for c in v], width)
        sparse += [((s + at) * MANY + c, (n + at) * width) for s, c, n in others]
        t = np.where(t >= 0, (t + at) * width, -1).astype(np.int32)
        tables.append(t)
        roots.append(at * width)
        at += len(t)
    sparse.sort()
    keys, to = (np.array([x[i] for x in sparse], np.int64) for i in (0, 1))
    return Model(list(samples), letters, np.concatenate(tables).ravel(), np.array(roots), width, keys, to)


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each normalised text by language, characters of each text)."""
    n_lang = len(model.languages)
    size = np.array([len(t) for t in texts], np.int64)
    count = np.zeros((len(texts), n_lang), np.int64)
    if not n_lang or not size.sum():
        return count, size
    point = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    codes = np.zeros(int(point.max()) + 1, np.int32 if len(model.letters) > 250 else np.uint8)
    for c, i in [(" ", 1), *((c, i + 2) for i, c in enumerate(model.letters))]:
        if ord(c) < len(codes):
            codes[ord(c)] = i
    symbols = codes[point]
    n_cut = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(texts)), n_cut)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_cut) - n_cut, n_cut)
    start = (np.cumsum(size) - size)[owner] + place * STRETCH
    length = np.minimum(size[owner] - place * STRETCH, STRETCH)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    state = np.zeros((n_lang, len(owner)), np.int64)
    found = np.zeros((n_lang, len(owner)), np.int64)
    root = model.roots[:, None]
    any_rare, none = bool((symbols >= model.width).any()), np.zeros(0, np.int64)
    for step in range(int(length[0])):
        live = int(np.searchsorted(-length, -step, "left"))  # stretches longer than step
        s = symbols[start[:live] + step].astype(np.int64)
        rare = np.flatnonzero(s >= model.width) if any_rare else none
        to = model.follow(state[:, :live], s, rare)
        ended = to < 0
        found[:, :live] += ended
        # a new phrase starts with this character; one that the sample lacks is a phrase
        again = np.maximum(model.follow(root, s, rare), 0)
        state[:, :live] = np.where(ended, again, to)
    np.add.at(count, owner, found.T)
    return count, size


def _samples(texts: DataFrame, docs: int, chars: int, languages: int = LANGUAGES) -> dict[str, str]:
    """Sample text of each language, from the ``docs`` documents whose hash of id
    and text is least; rows that repeat both count as one."""
    by_size = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    rows = texts.join(F.broadcast(by_size), "lang").withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (
        rows.select("lang", "h").distinct().withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= docs).select("lang", "h")
    )
    found: dict[str, str] = {}
    sampled = (
        rows.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, chars)).alias("text"))
    )
    for r in sorted(sampled.collect()):
        held = found.setdefault(r["lang"], "")
        if len(held) < chars:
            found[r["lang"]] = (held + " " + normalised(r["text"])).strip()[:chars]
    return found


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """A model from the documents with a language that are not held out.

    It reads sample_docs documents and sample_chars characters of each language,
    of LANGUAGES languages at most, the most frequent ones; rows are chosen by a
    hash of id and text, so rows that share an id, or have none, are sampled like
    others; null texts and null languages teach nothing.
    """
    usable = ~held_out(id_col, 4, 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    texts = docs.where(usable).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    return build(_samples(texts, sample_docs, sample_chars))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """STRUCT<lang_pred, score> of a text: the language that needs the fewest
    phrases for a character, and how many fewer than the next best, 0 to 1.

    Defined cases: a null text, one without letters, and any text when nothing
    was learned give ("und", 0); of languages that need equally few phrases the
    alphabetically first wins, with score 0; equal texts have equal results, so
    rows may repeat; texts of any length are read whole; an empty table stays
    empty; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain: workers lack this package

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        model = Model(*sent.value)
        texts = [normalised(t) for t in text]
        count, size = phrases(model, texts)
        if not model.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(text), "score": 0.0})
        best = count.argmin(1)
        least = count[np.arange(len(count)), best]
        others = np.where(np.arange(count.shape[1]) == best[:, None], np.iinfo(np.int64).max, count)
        second = others.min(1) if count.shape[1] > 1 else np.full(len(count), 1)
        score = 1 - least / np.maximum(second, 1) if count.shape[1] > 1 else np.ones(len(count))
        names = np.array(model.languages, object)[best]
        known = size > 0
        return pd.DataFrame(
            {"lang_pred": np.where(known, names, "und"), "score": np.where(known, score, 0.0)}
        )

    return predict(whole(text_col))
