"""Collocations against counts of every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np

from jobweir.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first=None):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for (lang, *ws), a in f.items():
        if len(ws) < 2 or a < least:
            continue
        inside = lambda big: any(big[i : i + len(ws)] == tuple(ws) for i in range(len(big) - len(ws) + 1))
        if any(x[0] == lang and len(x) - 1 > len(ws) and c >= least and c >= a and inside(x[1:]) for x, c in f.items()):
            continue
        cuts = [(f[(lang, *ws[:k])], f[(lang, *ws[k:])], k) for k in range(1, len(ws))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for l, r, k in cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), l, r, n[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, l, r, total in sorted(out):
        ranks[lang] += 1
        if first is None or ranks[lang] <= first:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, total, -score))
    return rows


def texts(n):
    g = random.Random(4)
    words = ["a", "b", "c", "Dd", "é", "É", "longer-than-eight", "x" * 700, "the"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " \x0b", "?! ", " \t "]
    rows = []
    for _ in range(n):
        k = g.choice([0, 1, 3, 40])
        rows.append(("".join(g.choice(words) + g.choice(marks) for _ in range(k)), g.choice(["en", "en", "fr", None, "und"])))
    same = " ".join(g.choices(words[:5], k=120))
    rows += [(same + str(i % 3), "en") for i in range(12)] + [("the " * 900, "fr"), (None, "en"), ("", None), (" ,. \n", "fr")]
    return rows


def test_equals_counting_all_phrases(spark, monkeypatch):
    rows = texts(60)
    docs = spark.createDataFrame([(t, x, "z", 1) for t, x in rows], "text string, lang string, phrase string, n int").repartition(3)
    for stretch, period in ((4 << 20, 48), (300, 3)):
        monkeypatch.setattr(co, "STRETCH", stretch)
        got = co.mined(docs, least=6, first=None, period=period)
        assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 6))
    assert sorted(map(tuple, co.mined(docs, least=6, first=5).collect())) == sorted(brute(rows, 6, 5))
    assert co.mined(docs.limit(0)).collect() == [] == co.mined(docs, least=10**6).collect()


def test_every_phrase_starts_in_one_chunk_and_copies_share_chunks():
    g = random.Random(1)
    shared = [str(g.randrange(1000)) for _ in range(600)]
    plain = [" ".join([f"own{i}"] * (3 + i) + shared).encode() for i in range(20)]
    chunks, of, words, overlap = co.parse(plain, 20, 4)
    f, want = Counter(), Counter()
    for c, k, o in zip(chunks, words, overlap):
        ws = c.split()
        assert len(ws) == k + o
        f.update(tuple(ws[i : i + 5]) for i in range(k) if i + 5 <= len(ws))
    for t in plain:
        ws = t.split()
        want.update(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    assert f == want
    assert len(set(chunks)) < len(chunks) / 5


def test_words_hash_by_their_text():
    ws = ["a", "ab", "abcdefgh", "abcdefghi", "é" * 9, "y" * 600, "a" * 16, "a" * 17, "a" * 24]
    w = co.Words([" ".join(ws + ws[::-1]).encode(), " ".join(ws).encode()])
    for h in w.hashes:
        assert (h[: len(ws)] == h[len(ws) : 2 * len(ws)][::-1]).all() and (h[: len(ws)] == h[2 * len(ws) :]).all()
        assert len(set(h.tolist())) == len(ws)
    assert (np.diff(w.text) >= 0).all() and list(w.count) == [2 * len(ws), len(ws)]
