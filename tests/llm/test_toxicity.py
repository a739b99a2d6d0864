"""The recurrent network: gradients, windows, held-out accuracy, edge cases."""

import random

import numpy as np

from jobweir.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def small(seed=0):
    g = np.random.default_rng(seed)
    net = tx.fresh_net(5, g, 0.3)
    return g, net._replace(**{k: v.astype(np.float64) for k, v in net._asdict().items()})


def test_gradients_are_those_of_the_loss():
    g, net = small()
    x = g.standard_normal((7, tx.WORD + tx.CHARS))
    at = g.integers(0, 7, (6, 4))
    here = (np.arange(6)[:, None] < np.array([6, 3, 1, 0])).astype(float)
    y = np.array([1, 0, 1, 0])

    def loss(n):
        logit = tx.forward(n, x @ n.into + n.base, at, here)
        return np.sum(np.log1p(np.exp(logit)) - y * logit)

    logit, kept = tx.forward(net, x @ net.into + net.base, at, here, keep=True)
    grads, d_gates = tx.backward(net, at, here, kept, 1 / (1 + np.exp(-logit)) - y, 7)
    grads["into"], grads["base"] = x.T @ d_gates, d_gates.sum(1, keepdims=True)
    for name, grad in grads.items():
        v = getattr(net, name)
        for place in {tuple(g.integers(0, s) for s in v.shape) for _ in range(12)}:
            step = np.zeros_like(v)
            step[place] = 1e-3
            numeric = (loss(net._replace(**{name: v + step})) - loss(net._replace(**{name: v - step}))) / 2e-3
            assert abs(numeric - grad[place]) < 2e-3 * max(1, abs(numeric)), (name, place)


def test_windows_cover_and_overlap():
    counts = np.array([0, 1, tx.STEP, tx.WINDOW, tx.WINDOW + 1, 1000])
    text, first, size = tx.windows(counts)
    for i, n in enumerate(counts):
        f, s = first[text == i], size[text == i]
        assert (f + s).max() == n and (f == np.arange(len(f)) * tx.STEP).all() and (s <= tx.WINDOW).all()
        assert len(f) == 1 or (s[:-1] == tx.WINDOW).all() and s[-1] > tx.WINDOW - tx.STEP


def test_score_is_the_highest_window_alone():
    """Windows scored together and one by one, in short and long texts."""
    g = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(g.choices(words, k=n)).encode() for n in (0, 1, 5, 47, 48, 49, 300, 2000)]
    y = np.array([0, 1, 0, 1, 0, 1, 0, 1.0])
    model = tx.fit(texts, y, rounds=1)
    want = []
    for t in texts:
        ws = t.split()
        n = max(1, -(-(len(ws) - tx.STEP) // tx.STEP))
        parts = [b" ".join(ws[k * tx.STEP : k * tx.STEP + tx.WINDOW]) for k in range(n)]
        want.append(max(model.logits([p])[0][0] for p in parts))
    assert np.allclose(model.scores(texts), model.score(np.array(want)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = tx.train(docs, labels, max_rows=2400)
    held = docs.join(labels.where("toxic is not null"), "doc_id").where(tx.held_out("doc_id", 4, 2))
    rows = tx.scored(held, model).select("doc_id", "toxic", "score").collect()
    hit = {r.doc_id for r in rows if r.score >= 0.3}
    bad = {r.doc_id for r in rows if r.toxic}
    assert len(hit & bad) > 0.8 * len(bad) and len(hit & bad) > 0.8 * len(hit)
    found = tx.passages(held, model).collect()
    assert {r.doc_id for r in found} == hit
    best = {}
    for r in found:
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.score)
    assert all(abs(best[r.doc_id] - r.score) < 1e-5 for r in rows if r.doc_id in hit)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "A fine text."), (3, "You Idiot"), (None, "idiot"), (4, "?!"), (5, "idiot " + "calm words " * 40_000)]
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (77, 0), (1, None), (5, 1), (5, 1)], "doc_id long, toxic int")
    docs = docs_of(rows)
    model = tx.train(docs, labels)
    got = tx.scored(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if not (r.text or "").strip("?!")]
    assert len(empty) == 3 and len(set(empty)) == 1
    none = tx.train(docs, labels.limit(0))
    assert len({r.score for r in tx.scored(docs, none).collect()}) == 1
    assert tx.scored(docs_of([]), none).collect() == [] == tx.passages(docs_of([]), none).collect()
