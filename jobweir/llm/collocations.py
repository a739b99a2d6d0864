"""Phrase collocations of a corpus, counted through prefix-free parsing.

Every text is cut where its content says so: where the hash of four words in a
row is 0 modulo PERIOD. A chunk runs from one such place to the end of the next
place's four words, so chunks overlap by exactly these, and texts that share a
passage share its chunks wherever they stand in it. The distinct chunks, with
the times each occurs, are the dictionary; all counting reads it and weighs a
chunk by its times. A phrase has at most five words, so it lies whole in the
chunk in which it starts; the four words that overlap start nothing there, so
each occurrence is counted once.

Phrases are counted length by length. A phrase of n words is looked at only if
both phrases of n - 1 words in it are frequent, which a bitmap of hashed phrases
tells; what the bitmap lets through beyond that costs time, never a result, and
its size is bounded whatever the corpus. Counts are summed under the phrase
itself, so hashes decide no result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, whole, written
from .shingles import mix

LEAST, MOST_WORDS, FIRST = 100, 5, 2000
#: Words of a chunk, about, beside the words that it shares with the next one.
PERIOD = 48
#: Bytes of text, or of chunks, that a task looks at together.
STRETCH = 4 << 20
#: Bits for each frequent phrase in a bitmap, and bits of a bitmap at most.
BITS_EACH, BITS = 16, 1 << 27
#: Longer words are hashed by a library, not by blocks of 8 bytes.
LONG = 512

_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)
_BREAK, _BLANKS = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")
_TIMES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_PLUS = [np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def plain(text: str) -> bytes:
    """A text in UTF-8 with A-Z lower-cased, one blank between the words of a
    piece and one line end between pieces."""
    raw = _BREAK.sub(b"\n", text.encode().translate(_FOLD))
    if b"  " in raw:
        raw = _BLANKS.sub(b" ", raw)
    return raw.strip(b" \n")


class Words:
    """The words of some plain texts, which are not empty: places, hashes, texts."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        seen = np.frombuffer(self.raw + bytes(16), np.uint8)
        text = seen[: len(self.raw)]
        self.stop = np.flatnonzero((text == 32) | (text == 10))
        self.start = np.concatenate([[0], self.stop[:-1] + 1])
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        self.text = np.searchsorted(ends, self.start, "right")
        self.count = np.bincount(self.text, minlength=len(texts))
        self.last = np.cumsum(self.count)  # one past each text's last word
        #: Whether the next word follows in the same piece.
        self.joined = text[self.stop] == 32
        self.hashes = self._hashed(seen)

    def _hashed(self, seen: np.ndarray) -> list[np.ndarray]:
        eights = np.lib.stride_tricks.as_strided(seen[:8].view("<u8"), (len(seen) - 7,), (1,))
        size = self.stop - self.start
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        block = eights[self.start] & mask[np.minimum(size, 8)]
        out = [mix(block + p) for p in _PLUS]
        at = 8
        rest = np.flatnonzero((size > 8) & (size <= LONG))
        while len(rest):
            block = eights[self.start[rest] + at] & mask[np.minimum(size[rest] - at, 8)]
            for h, t, p in zip(out, _TIMES, _PLUS):
                h[rest] = mix(h[rest] * t + block + p)
            at += 8
            rest = rest[size[rest] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            d = hashlib.blake2b(self.raw[self.start[i] : self.stop[i]], digest_size=16).digest()
            out[0][i], out[1][i] = np.frombuffer(d, np.uint64)
        return out

    def rolled(self, n: int, which: int = 0) -> np.ndarray:
        """Hashes of n words from each word on; the last n - 1 mean nothing."""
        word = self.hashes[which]
        h = word.copy()
        for k in range(1, min(n, len(h))):
            h[:-k] = h[:-k] * _TIMES[which] + word[k:]
        return h

    def slices(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The texts from word first to word last."""
        raw = self.raw
        return [raw[a:b] for a, b in zip(self.start[first].tolist(), self.stop[last].tolist())]


def parse(texts: list[bytes], period: int, overlap: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of plain texts: (chunk, text, words that start in it, words
    that it shares with the next one)."""
    w = Words(texts)
    index = np.arange(len(w.start))
    cut = (mix(w.rolled(overlap) + _PLUS[1]) % np.uint64(period) == 0) & (index + overlap <= w.last[w.text])
    cut |= index == (w.last - w.count)[w.text]
    first = np.flatnonzero(cut)
    after = np.append(first[1:], len(index))
    ends = after == w.last[w.text[first]]
    chunks = w.slices(first, np.where(ends, after, after + overlap) - 1)
    return chunks, w.text[first], after - first, np.where(ends, 0, overlap)


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _grams(w: Words, langs: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of n words and their language, of each word on."""
    return mix(w.rolled(n, which) + langs[w.text] * _PLUS[which])


# --- Spark ------------------------------------------------------------------


def dictionary(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    period: int = PERIOD,
    overlap: int = MOST_WORDS - 1,
) -> DataFrame:
    """The distinct chunks of all texts: lang, chunk, shared (its last words that
    belong to the next chunk), words (those that start in it), times."""
    small_batches(docs.sparkSession)
    stretch = STRETCH

    def parsed(batches):
        langs, texts, held = [], [], 0

        def out():
            chunks, of, words, shared = parse(texts, period, overlap)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(pa.array(of)),
                    pa.array(chunks, pa.binary()).cast(pa.string()),
                    pa.array(shared, pa.int32()),
                    pa.array(words, pa.int64()),
                ],
                names=["lang", "chunk", "shared", "words"],
            )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = plain(text.as_py())
                if text:
                    langs.append(lang)
                    texts.append(text)
                    held += len(text)
                if held >= stretch // 4:
                    yield out()
                    langs, texts, held = [], [], 0
        if texts:
            yield out()

    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), whole(text_col).alias("text"))
    return (
        rows.mapInArrow(parsed, "lang string, chunk string, shared int, words long")
        .groupBy("lang", "chunk", "shared")
        .agg(F.max("words").alias("words"), F.count("*").alias("times"))
    )


def _counted(chunks: DataFrame, n: int, known: tuple[bytes, int] | None) -> DataFrame:
    """lang, phrase, f: all phrases of n words; with known, a bitmap, only those
    whose two parts of n - 1 words it holds."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(known)
    stretch = STRETCH

    def count(batches):
        bits = None
        if sent.value:
            bits, mask = np.frombuffer(sent.value[0], np.uint8), np.uint64(sent.value[1] - 1)
        names: dict[str, int] = {}
        parts, held = [], 0

        def out():
            texts = [c.encode() for p in parts for c in p[1]]
            lang = np.concatenate([p[0] for p in parts])
            shared, times = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            w = Words(texts)
            listed = list(names)
            langs = np.array([_lang_hash(x) for x in listed], np.uint64)[lang]
            index = np.arange(len(w.start))
            inside = index < (w.last - shared)[w.text]
            for k in range(min(n - 1, len(index))):  # the last word is never joined
                inside[: len(inside) - k] &= w.joined[k:]
                inside[len(inside) - k :] = False
            if bits is not None:
                place = _grams(w, langs, n - 1) & mask
                held = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                inside[:-1] &= held[:-1] & held[1:]
            at = np.flatnonzero(inside)
            if not len(at):
                return None
            h, g = _grams(w, langs, n)[at], _grams(w, langs, n, 1)[at]
            order = np.argsort(h)
            h, g = h[order], g[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            f = np.add.reduceat(times[w.text[at]][order], new)
            chosen = at[order[new]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(listed, pa.string()).take(pa.array(lang[w.text[chosen]])),
                    pa.array(w.slices(chosen, chosen + n - 1), pa.binary()).cast(pa.string()),
                    pa.array(f, pa.int64()),
                ],
                names=["lang", "phrase", "f"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            lang = np.array([names.setdefault(x, len(names)) for x in b.column(0).to_pylist()])
            texts = b.column(1).to_pylist()
            parts.append((lang, texts, b.column(2).to_numpy(), b.column(3).to_numpy()))
            held += sum(map(len, texts))
            if held >= stretch:
                found = out()
                if found is not None:
                    yield found
                parts, held = [], 0
        if parts:
            found = out()
            if found is not None:
                yield found

    return (
        chunks.select("lang", "chunk", "shared", "times")
        .mapInArrow(count, "lang string, phrase string, f long")
        .groupBy("lang", "phrase")
        .agg(F.sum("f").alias("f"))
    )


def _bitmap(frequent: DataFrame, n: int, n_rows: int) -> tuple[bytes, int]:
    """A bitmap of the hashes of frequent phrases of n words, and its bits."""
    size = 1 << 16
    while size < min(BITS_EACH * n_rows, BITS):
        size *= 2

    def hashed(batches):
        for b in batches:
            if b.num_rows:
                w = Words([p.encode() for p in b.column(1).to_pylist()])
                langs = np.array([_lang_hash(x) for x in b.column(0).to_pylist()], np.uint64)
                h = _grams(w, langs, n)[w.last - w.count] & np.uint64(size - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h >> np.uint64(3)).astype(np.int64)), pa.array((1 << (h & np.uint64(7)).astype(np.int32)))],
                    names=["place", "bit"],
                )

    found = (
        frequent.select("lang", "phrase")
        .mapInArrow(hashed, "place long, bit int")
        .groupBy("place")
        .agg(F.bit_or("bit").alias("byte"))
        .toArrow()
    )
    out = np.zeros(size // 8, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.tobytes(), size


def frequent(chunks: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, phrase, k, f: every phrase of up to most_words words that occurs
    least times or more in its language, k being its words."""
    out, known = None, None
    for n in range(1, most_words + 1):
        level = written(_counted(chunks, n, known).where(F.col("f") >= least), f"phrases-{n}")
        n_rows = level.count()
        with_k = level.withColumn("k", F.lit(n))
        out = with_k if out is None else out.unionByName(with_k)
        if not n_rows:
            break
        if n < most_words:
            known = _bitmap(level, n, n_rows)
    return out


def mined(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    first: int | None = FIRST,
    period: int = PERIOD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by
    their lowest-scoring cut (all of them if first is None).

    Defined cases: a null text is empty and a null language 'und'; every row
    counts, repeated ones again, whatever its id; texts and words are of any
    length; equal scores and counts are ranked by the phrase in byte order; other
    columns are ignored; an empty table, or one without a phrase that occurs
    least times, gives no rows.
    """
    chunks = written(dictionary(docs, text_col, lang_col, period, most_words - 1), "chunks")
    counts = frequent(chunks, least, most_words)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    words = F.split("phrase", " ")
    candidates = counts.where("k >= 2").withColumnRenamed("f", "a")

    # a longer phrase with the same count implies one that is one word longer
    longer = candidates.where("k >= 3").select(
        "lang", "a", F.explode(F.array(F.slice(words, 1, F.col("k") - 1), F.slice(words, 2, F.col("k") - 1))).alias("w")
    )
    held = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = (
        candidates.join(held, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
        .drop("longer")
    )

    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a AS {wide}) * cast(n AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))")
    scored = (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best"))
        .select("lang", "phrase", "best.*")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
