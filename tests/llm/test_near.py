"""Near-duplicates: shingles, sampling, similarity and classes against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweir.llm import near_dedup as nd
from jobweir.llm.shingles import Shingler


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def shingles(t):
    w = words(t)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def prose(g, n):
    return " ".join("".join(g.choice("abcdefgh") for _ in range(g.randint(2, 6))) for _ in range(n))


def edit(g, text, n):
    w = text.split()
    for _ in range(n):
        w[g.randrange(len(w))] = prose(g, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def cases():
    g = random.Random(4)
    rows, passage = [], prose(g, 60)
    for _ in range(12):
        text = prose(g, g.randint(60, 300))
        rows += [text, text, edit(g, text, 1), edit(g, text, 3), edit(g, text, 12), text.upper() + " !!"]
    hot = prose(g, 150)
    rows += [edit(g, hot, g.randint(0, 3)) for _ in range(60)] + [hot] * 30
    rows += [f"{prose(g, g.randint(10, 90))} {passage} {prose(g, 30)}" for _ in range(60)]
    rows += ["", None, "  ", "one two", "One, two!", "solo", "la " * 400, "la " * 420]
    return list(enumerate(rows))


def test_shingles_equal_a_plain_count(cases):
    texts = [t or "" for _, t in cases]
    h, doc, times = Shingler().counted(texts)
    seen = {}
    for i, t in enumerate(texts):
        want, mine = shingles(t), sorted(times[doc == i].tolist())
        assert mine == sorted(want.values()), t[:50]
        assert len(set(h[doc == i].tolist())) == len(want)
    # the same shingle has the same hash in every text
    for i, t in enumerate(texts):
        if len(words(t)) == 5:
            seen.setdefault(tuple(words(t)), set()).add(int(h[doc == i][0]))
    assert all(len(v) == 1 for v in seen.values())


def test_samples_agree_like_the_weighted_similarity():
    g = np.random.default_rng(1)
    h = g.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = g.integers(1, 6, 300) * 1.25, g.integers(1, 6, 300) * 1.25
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sampler = nd.Sampler(2000)
    sa, sb = (sampler.samples(h, w, np.array([0]))[0] for w in (a, b))
    assert abs((sa == sb).mean() - want) < 0.05
    # disjoint sets never agree, equal ones always
    other = sampler.samples(h + np.uint64(1), a, np.array([0]))[0]
    assert (sa == other).mean() < 0.01 and (sa == sampler.samples(h[::-1].copy(), a[::-1].copy(), np.array([0]))[0]).all()


def brute(rows, weights):
    """Class of each row: the least id that links of similarity 0.8 or more lead to."""
    sets = {i: {s: n for s, n in shingles(t).items()} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    ids = [i for i, _ in rows]
    text = dict(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (text[i] or "") == (text[j] or ""):
                join(i, j)
                continue
            a, b = sets[i], sets[j]
            keys = a.keys() | b.keys()
            top = sum(weights(s) * min(a.get(s, 0), b.get(s, 0)) for s in keys)
            all_ = sum(weights(s) * max(a.get(s, 0), b.get(s, 0)) for s in keys)
            if all_ and top / all_ >= 0.8 - 1e-9:
                join(i, j)
    return {i: find(i) for i in ids}


def test_classes(cases, docs_of):
    df = Counter()
    for _, t in cases:
        df.update(shingles(t).keys())
    n = len(cases)

    def weight(s):
        if df[s] < max(2, nd.COMMON * n):
            return 1 + nd.IDF
        return 1 + nd.IDF * min(1, np.log(n / df[s]) / np.log(1 / nd.COMMON))

    got = {r.doc_id: r.class_id for r in nd.classes(docs_of(cases)).collect()}
    assert got == brute(cases, weight)


def test_counting_without_sending(cases, docs_of, monkeypatch):
    texts = docs_of(cases).select("text").na.fill("")
    a = {r.h: r.n for r in nd.frequent_shingles(texts, len(cases)).collect()}
    monkeypatch.setattr(nd, "SENT", -1)
    b = {r.h: r.n for r in nd.frequent_shingles(texts, len(cases)).collect()}
    assert a == b and len(a) > 50


def test_edges(docs_of):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "x"), (7, None), (8, "")]
    got = sorted(((r.doc_id, r.class_id) for r in nd.classes(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(None, None), (3, 3), (3, 3), (2, 2), (7, 7), (8, 7)], key=repr)
    kept = nd.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 3, 2, 7], key=repr)
    assert nd.classes(docs_of([])).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 25)] + [(40, 41)], "u long, v long")
    got = {r.node: r.label for r in nd.components(links).collect()}
    assert got == {i: 10 for i in range(10, 26)} | {40: 40, 41: 40}


def test_components_by_rounds(spark):
    links = spark.createDataFrame([(9, 30), (30, 12), (12, 31), (5, 31), (50, 60)], "u long, v long")
    got = {r.node: r.label for r in nd.components(links).collect()}
    assert got == {5: 5, 9: 5, 12: 5, 30: 5, 31: 5, 50: 50, 60: 50}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    part = {r.node: r.label for r in nd.components(chain, rounds=1).collect()}
    assert len(set(part.values())) > 1 and all(v <= k for k, v in part.items())


def test_a_star_whose_centre_has_the_largest_id(docs_of):
    """Copies are alike to the original, not to each other; it comes last."""
    g = random.Random(5)
    text = prose(g, 254)
    rows = list(enumerate([edit(g, text, 4) for _ in range(80)] + [text]))
    got = {r.doc_id: r.class_id for r in nd.classes(docs_of(rows)).collect()}
    assert set(got) == set(range(81)) and set(got.values()) == {0}


def test_likely_pairs_lose_none_that_agrees(spark):
    g = np.random.default_rng(3)
    a = g.integers(-(2**31), 2**31, (200, 70))
    b = np.where(g.random((200, 70)) < g.random((200, 1)), a, a + 1)
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    both = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    nodes = spark.createDataFrame(
        [], "node long, least long, a long, b long, size double, samples array<int>"
    )
    source = spark.createDataFrame([], "doc_id long, a long, b long, text string")
    search = nd.Search(source, nodes, None, 0.8, 70)
    planes = both.select("i", nd.planes(F.col("a"), 70).alias("p"), nd.planes(F.col("b"), 70).alias("q"))
    got = {r.i for r in planes.where(search.likely("p", "q")).collect()}
    enough = {i for i in range(200) if (a[i] == b[i]).sum() >= search.enough * 70}
    assert enough <= got and len(got - enough) <= 2


def test_frequent_shingles_in_short_stretches(docs_of):
    """Held by 4 of 200 documents, one in each of four partitions."""
    g = random.Random(8)
    shared = prose(g, 5)
    rows = [(i, shared if i % 50 == 7 else prose(g, 5)) for i in range(200)]
    texts = docs_of(rows).select("text").coalesce(4)
    assert texts.rdd.getNumPartitions() == 4
    got = [r.n for r in nd.frequent_shingles(texts, 200).collect()]
    assert got == [4]


@pytest.mark.parametrize("idf", [0.0, nd.IDF])
def test_recall_in_hot_buckets(docs_of, idf):
    """A third of all texts shares a long passage, a third is copies of one text;
    by plain Jaccard and by the weights that the query uses."""
    g = random.Random(21)
    passage, base = prose(g, 120), prose(g, 150)
    texts = [f"{passage} {prose(g, g.choice([2, 5, 8, 12, 16, 20, 30, 50, 80]))}" for _ in range(200)]
    texts += [edit(g, base, g.randint(0, 7)) for _ in range(200)]
    texts += [prose(g, g.randint(20, 120)) for _ in range(200)]
    rows = list(enumerate(texts))
    sets = [frozenset(shingles(t)) for t in texts]
    df = Counter(s for x in sets for s in x)
    n = len(texts)
    weight = {
        s: 1 + idf * (1 if c < max(2, nd.COMMON * n) else min(1, np.log(n / c) / np.log(1 / nd.COMMON))) for s, c in df.items()
    }
    total = [sum(map(weight.get, x)) for x in sets]
    links = []
    for i in range(400):
        for j in range(i):
            both = sum(map(weight.get, sets[i] & sets[j]))
            if both >= 0.8 * (total[i] + total[j] - both) - 1e-9:
                links.append((i, j))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(n)}
    got = {r.doc_id: r.class_id for r in nd.classes(docs_of(rows), idf=idf).collect()}
    assert all(want[i] == want[got[i]] for i in got)  # no class is too large
    assert np.mean([got[i] == got[j] for i, j in links]) > 0.99
    merges = n - len(set(want.values()))
    assert merges > 100 and len(set(got.values())) - len(set(want.values())) <= 0.02 * merges


def test_very_long_texts_and_ties(docs_of):
    g = random.Random(2)
    long = prose(g, 30_000)
    rows = [(9, long), (4, long + " end"), (7, "a b c d e f g"), (2, "a b c d e f g"), (3, "x" * 300_000)]
    got = {r.doc_id: r.class_id for r in nd.classes(docs_of(rows)).collect()}
    assert got == {9: 4, 4: 4, 7: 2, 2: 2, 3: 3}


def test_versions_of_one_id(docs_of):
    a, b = "one two three four five six", "quite another text of seven words here"
    rows = [(5, a), (5, b), (3, a), (8, b)]
    got = {(r.doc_id, r.class_id) for r in nd.classes(docs_of(rows)).collect()}
    assert got == {(5, 3), (3, 3), (8, 3)}
    kept = sorted((r.doc_id, r.text) for r in nd.keep_one(docs_of(rows)).collect())
    assert kept == [(3, a), (5, b)]  # each version by its own text
    clashing = docs_of(rows).withColumnsRenamed({"th": "_gone", "pos": "i", "label": "a"})
    assert nd.keep_one(clashing).columns == clashing.columns


def test_deals_go_on_without_a_link(spark, monkeypatch):
    class Turns:
        k, labels, found, turns = nd.K, None, True, 0

        def settle(self, left, **_):
            self.turns, self.found = self.turns + 1, False
            return left if self.turns < 6 else None

        def split(self, left, level):
            return left

    monkeypatch.setattr(nd, "crowding", lambda bands, labels=None: bands)
    search = Turns()
    nd.find_links(spark.createDataFrame([(1, 1, True)], "bucket long, node long, first boolean"), search)
    assert search.turns == 6


def test_postings_lose_no_link_of_a_crowd(docs_of):
    """Sixty texts share half of their words; every link meets under a rare shingle."""
    g = random.Random(12)
    passage, texts = prose(g, 60), []
    for _ in range(20):
        text = f"{passage} {prose(g, g.randint(20, 90))}"
        texts += [text, edit(g, text, 1), edit(g, text, 2)]
    sets = [shingles(t) for t in texts]
    links = {
        (j, i) for i in range(60) for j in range(i)
        if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()
    }
    assert 20 < len(links) < 100

    frequent = np.sort(Shingler().counted([passage])[0])

    class Plain(nd.Search):
        def __init__(self, texts):
            self.threshold, self.texts = 0.8, texts

        def likely(self, p, q):
            return F.lit(True)

    class Sent:
        value = (frequent, np.full(len(frequent), 1 - 1e-9), 1.0)

    docs = docs_of(list(enumerate(texts))).select(F.col("doc_id").alias("node"), "text")
    search = Plain(docs)
    search.weights = Sent()
    sizes = F.array(*[F.lit(float(x.total())) for x in sets])
    members = search.split(docs, 1).withColumn("size", F.get(sizes, F.col("node").cast("int")))
    members = members.withColumns({"label": F.col("node"), "planes": F.lit(0)})
    met = [(r.u, r.v) for r in search.met(members, members, F.col("node") < F.col("other_node")).collect()]
    assert links <= set(met) and len(set(met)) < 3 * len(links)
