"""Ranked lexical search against scores worked out term by term."""

import math
import random
from collections import Counter

import numpy as np

from jobweir.llm import ball_search as bs

SF = "/root/testdata/sf0.001"


def brute(items, docs, k=20):
    counted = [(i, Counter(bs.terms(t or ""))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(bs.terms(t or ""))
    out = []
    for item, q in queries.items():
        found = []
        for doc_id, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, r in q.items()
                if t in c
            )
            if score > 0:
                found.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_all_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute(items.select("item_id", "text").collect(), docs.select("doc_id", "text").collect())
    assert rows(bs.ranked(items, docs)) == want and want


def test_blocks_ties_and_edges(spark, docs_of, monkeypatch):
    g = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Élan", "élan", "ÉLAN", "日本", "a1", "x́"]
    texts = [(i, " ".join(g.choices(words, k=g.choice([1, 3, 30])))) for i in range(300)]
    texts += [(300 + i, texts[0][1]) for i in range(50)]  # ties
    texts += [(7, texts[3][1]), (7, "w1 w2"), (None, texts[0][1]), (400, None), (401, ""), (402, "... !")]
    texts += [(403, "w1 filler " * 30_000 + "w39")]
    items = [(i, " ".join(g.choices(words, k=6))) for i in range(12)] + [(12, texts[0][1]), (13, None), (14, "unheard-of")]
    items += [(0, "w3 W3 w4"), (None, "w5 w6"), (15, "w39")]
    items = [(i, t, "x") for i, t in items]
    monkeypatch.setattr(bs, "ITEMS", 5)
    monkeypatch.setattr(bs, "TREE_TERMS", 500)
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = bs.ranked(table, docs_of(texts), k=7)
    assert rows(got) == brute([i[:2] for i in items], texts, 7)
    assert rows(bs.ranked(table, docs_of([]))) == [] == rows(bs.ranked(table.limit(0), docs_of(texts)))
    assert [f.simpleString() for f in got.schema] == ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]


def test_trees_prune_and_lose_nothing():
    g = np.random.default_rng(3)
    n, v = 4000, 600
    sets = [np.unique(np.minimum(v * g.random(12) ** 3, v - 1).astype(int)) for _ in range(n)]
    sizes = np.array([len(s) for s in sets])
    docs = bs.Docs(
        np.arange(n).astype(object), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets), g.integers(1, 10**6, sizes.sum())
    )
    weight = np.linspace(1, 9000, v).astype(np.int64)
    tree = bs.build(docs, weight.astype(float))
    assert sorted(tree.docs.ids) == list(range(n))
    n_leaves = sum(c is None for c in tree.children)
    scored = 0
    for _ in range(20):
        used = np.unique(g.integers(v // 3, v, 6))
        dense = np.zeros(v, np.int64)
        dense[used] = weight[used]
        all_scores = docs.dots(dense)
        best = sorted(((-s, i) for i, s in enumerate(all_scores.tolist()) if s), key=lambda x: x)[:20]
        found = bs.Found(20, 0)
        scored += bs.search(tree, dense, used, weight.astype(float), found)
        assert sorted((-e[0], e[2]) for e in found.heap) == best
        seeded = bs.Found(20, found.need)
        bs.search(tree, dense, used, weight.astype(float), seeded)
        assert sorted(seeded.heap) == sorted(found.heap)
    assert scored < 0.7 * 20 * n_leaves
