"""Quality classifier and language ID: held-out accuracy and edge cases."""

import random

import numpy as np
import pytest

from jobweir.llm import language_id as li, quality_gam as qg

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = qg.train(docs, labels)
    rows = (
        qg.scored(docs, model).where(qg.held_out("doc_id")).join(labels, "doc_id").select("quality", "score").collect()
    )
    good = [(r.score >= 0.5) == bool(r.quality) for r in rows]
    assert np.mean(good) > 0.95
    bad = [r.score < 0.5 for r in rows if not r.quality]
    assert np.mean(bad) > 0.85


def test_quality_edges(docs_of, spark):
    rows = [(1, None), (2, ""), (3, "A fine text, of words."), (3, "again"), (None, "x")]
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (77, 0), (1, None)], "doc_id long, quality int")
    docs = docs_of(rows)
    model = qg.train(docs, labels)
    got = qg.scored(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = qg.train(docs, labels.limit(0))
    assert {r.score for r in qg.scored(docs, none).collect()} == {0.5}
    assert qg.keep_good(docs, none).columns == docs.columns
    assert qg.scored(docs_of([]), none).collect() == []


def test_pairs_learn_what_single_features_cannot():
    g = np.random.default_rng(0)
    x = g.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = qg.fit(x, y, n_pairs=2)
    assert np.mean((model.score(x) > 0.5) == y) > 0.97
    assert (1, 0) in model.pairs


def brute_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("symbols", [li.SYMBOLS, 2, 0])
def test_phrases_are_longest_matches(symbols):
    """With all letters in dense tables, with a few, with none."""
    g = random.Random(3)
    samples = {k: "".join(g.choice(a) for _ in range(600)) for k, a in (("p", "ab c"), ("q", "bcd "))}
    model = li.build(samples, symbols)
    texts = ["".join(g.choice("abcd x") for _ in range(n)) for n in (0, 1, 5, 200, 1400)]
    count, size = li.phrases(model, texts)
    assert size.tolist() == [len(t) for t in texts]
    for t, row in zip(texts, count):
        cuts = [t[i : i + li.STRETCH] for i in range(0, len(t), li.STRETCH)]
        want = [sum(brute_phrases(samples[k], c) for c in cuts) for k in model.languages]
        assert row.tolist() == want


def test_large_alphabets_keep_their_letters():
    """Three languages of 400 letters each, half of them shared."""
    g = random.Random(12)
    letters = [chr(0x4E00 + i) for i in range(1000)]
    own = {f"l{k}": letters[k * 200 : k * 200 + 400] for k in range(3)}
    words = {k: ["".join(g.choice(v) for _ in range(g.randint(1, 3))) for _ in range(300)] for k, v in own.items()}
    prose = lambda k, n: " ".join(g.choice(words[k]) for _ in range(n))
    model = li.build({k: prose(k, 6000) for k in own})
    assert len(model.letters) > 62 and len(model.keys)
    for k in own:
        count, _ = li.phrases(model, [prose(k, 40) for _ in range(20)])
        assert (count.argmin(1) == model.languages.index(k)).all()


def test_equal_languages_and_clashing_columns(spark):
    rows = [(1, "aa bb aa bb", "y", 0, 0.5), (3, "aa bb aa bb", "x", 0, 0.5), (3, "aa bb aa bb", "x", 0, 0.5), (5, "z" * 100_000, None, 0, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, score double")
    got = docs.select("*", li.predicted(docs, li.train(docs)).alias("p")).collect()
    assert [r.p.lang_pred for r in got if r.doc_id < 5] == ["x"] * 3 and all(r.p.score == 0 for r in got if r.doc_id < 5)


def test_a_score_is_a_sum_of_lookups():
    """Scores and tables against plain loops."""
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    m = qg.fit(x, y, bins=6, pair_bins=3, n_pairs=2, rounds=5, pair_rounds=5)
    for row, got in zip(x, m.score(x)):
        place = lambda edges, v: sum(v >= e for e in edges)
        total = m.intercept + sum(t[place(e, v)] for e, t, v in zip(m.edges, m.tables, row))
        for (i, j), t in zip(m.pairs, m.pair_tables):
            total += t[place(m.pair_edges[i], row[i]), place(m.pair_edges[j], row[j])]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_trees_are_the_best_of_all():
    g = np.random.default_rng(5)
    gain = lambda a, b: a.sum() ** 2 / (b.sum() + 2.0)
    for _ in range(30):
        a, b = g.normal(size=7), g.random(7) + 0.1
        best = max((gain(a[:k], b[:k]) + gain(a[k:], b[k:]) - gain(a, b), k) for k in range(1, 7))
        got = qg._best_cut(a, b, 2.0)
        assert abs(got[0] - best[0]) < 1e-9 and got[1] == best[1]
        p, q = g.normal(size=(4, 5)), g.random((4, 5)) + 0.1
        whole = max(
            sum(gain(u, v) for u, v in ((p[:i, :j], q[:i, :j]), (p[:i, j:], q[:i, j:]), (p[i:, :j], q[i:, :j]), (p[i:, j:], q[i:, j:])))
            for i in range(1, 4) for j in range(1, 5)
        )
        assert abs(qg._quarters(p, q, 2.0)[0] - (whole - gain(p, q))) < 1e-9


def test_quality_repeats_and_clashing_columns(spark):
    rows = [(1, "One good text.", 9.0), (1, "One good text.", 8.0), (2, "x" * 100_000, 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    model = qg.train(docs, labels)
    got = qg.scored(docs, model).collect()
    assert len(got) == 3 and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    assert qg.keep_good(docs, model).columns == docs.columns


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.train(docs)
    rows = docs.where(li.held_out("doc_id", 4, 2)).select("lang", li.predicted(docs, model).alias("p")).collect()
    assert np.mean([r.p.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (4, "der hund und die katze", "de"), (5, "12 !", None), (6, None, "en"), (None, "the", None)],
        "doc_id long, text string, lang string",
    )
    got = {r.doc_id: r.p for r in docs.select("doc_id", li.predicted(docs, li.train(docs)).alias("p")).collect()}
    assert got[5].lang_pred == "und" and got[6].lang_pred == "und" and got[5].score == 0
    nothing = li.train(docs.limit(0))
    assert {r.p.lang_pred for r in docs.select(li.predicted(docs, nothing).alias("p")).collect()} == {"und"}


@pytest.mark.parametrize("text", ["", "x" * 100_000, "é " * 5000])
def test_features_of_odd_texts(text):
    assert len(qg.features(text)) == len(qg.FEATURES) and all(np.isfinite(qg.features(text)))


def test_samples_of_rows_without_ids_and_of_many_languages(spark):
    g = random.Random(8)
    alphabets = {f"l{k:03d}": [chr(0x4E00 + 40 * k + i) for i in range(30)] for k in range(300)}
    rows = [(None, lang, "".join(g.choices(a, k=60))) for lang, a in alphabets.items() for _ in range(1 + (lang < "l256"))]
    rows += [(None, "many", "abc def ghi " + str(i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = li.train(docs, sample_docs=20)
    assert len(model.languages) == li.LANGUAGES and "many" in model.languages and "l299" not in model.languages
    got = docs.where("lang in ('l003', 'l120', 'many')").select("lang", li.predicted(docs, model).alias("p")).collect()
    assert all(r.lang == r.p.lang_pred for r in got)
