"""Match data, relevance, nearness and folding against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from jobweir.functions import match
from jobweir.operators import textindex as ti

ROW = "id long, title string, location string, department string, description string"
WORDS = ["rust", "zig", "go", "dev", "x", "y"]


def a_job(g, i):
    text = lambda n: g.choice([None, " ".join(g.choices(WORDS, k=g.randint(0, n)))])
    return (i, text(3), text(1), text(2), text(12))


def words_of(row):
    return " ".join(x or "" for x in row[1:]).split()


def rank(rows, words):
    all_ = {r[0]: words_of(r) for r in rows}
    n, mean = len(all_), sum(map(len, all_.values())) / max(1, len(all_))
    df = {w: sum(w in t for t in all_.values()) for w in words}
    out = {}
    for i, t in all_.items():
        c, s = Counter(t), 0.0
        for w in words:
            s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        out[i] = -s
    return out


def test_statistics_stay_in_step_and_bounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 10)
    g = random.Random(6)
    state = {i: a_job(g, i) for i in range(60)}
    index = ti.entries(spark.createDataFrame(list(state.values()), ROW))
    stats = ti.statistics(index)
    for turn in range(2):
        edits = [a_job(g, i) if g.random() < 0.7 else state.get(i, a_job(g, i)) for i in g.sample(range(90), 30)]
        gone = g.sample(range(90), 10)
        new = ti.changed(index, spark.createDataFrame(edits, ROW), spark.createDataFrame([(i,) for i in gone], "id long"))
        state |= {r[0]: r for r in edits}
        for i in gone:
            state.pop(i, None)
        index, stats = spark.createDataFrame(new.index.collect(), new.index.schema), ti.added(stats, new.delta)
    want = Counter(w for r in state.values() for w in set(words_of(r)))
    got = {r.term: (r.docs, r.total) for r in stats.collect()}
    assert got == {w: (n, 0) for w, n in want.items()} | {"": (len(state), sum(len(words_of(r)) for r in state.values()))}
    assert {r.id for r in index.select("id").collect()} == set(state)
    words = ["rust", "zig"]
    of = ti.corpus(stats, words)
    ranks = rank(state.values(), words)
    for r in ti.ranked(index, of, words).collect():
        assert abs(r["rank"] - ranks[r.id]) < 1e-9
    for k in (1, 7, 200):
        best = ti.best(index, ti.bounds(index), of, words, k, seeds=1).collect()
        want = sorted((round(v, 9), i) for i, v in ranks.items() if v < 0)[:k]
        assert [(round(r["rank"], 9), r.id) for r in best] == want
    assert ti.corpus(ti.statistics(index.limit(0)), ["q"]) == ti.Corpus(0, 0.0, (0,))


def test_near_all_is_a_window_of_phrases(spark):
    g = random.Random(9)
    rows = [(i, " ".join(g.choices("abcd", k=g.randint(0, 14))), None, None, None) for i in range(200)]
    df = match.with_tokens(spark.createDataFrame(rows, ROW))
    for phrases, within in (([["a"], ["b"], ["c"]], 2), ([["a", "b"], ["c"]], 1), ([["a"]], 0), ([["a", "a"], ["d", "b"], ["c"]], 3)):

        def here(t):
            at = [[i for i in range(len(t)) if t[i : i + len(p)] == p] for p in phrases]
            return any(
                all(any(i <= s and s - i - len(p) <= within for i in places) for p, places in zip(phrases, at))
                for places in at
                for s in places
            )

        got = {r.id for r in df.where(match.near_all(phrases, within)).select("id").collect()}
        assert got == {r[0] for r in rows if here(r[1].split())}


def test_accents_fold(spark):
    texts = ["Škoda Şahin Győr Łódź ŽIŽEK", "Ünï cödé été ầ ǆ ß"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(match.tokens(F.col("t"))).collect()]
    assert got == [["skoda", "sahin", "gyor", "łodz", "zizek"], ["uni", "code", "ete", "ầ", "ǆ", "ß"]]
