"""What Python workers hold: between stages and while they work."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from jobweir.llm import common, near_dedup as nd
from jobweir.llm.tokens import Encoder


def batch(n_texts, n_words):
    g = np.random.default_rng(3)
    texts = [" ".join(map(str, row)) for row in g.integers(0, 10**6, (n_texts, n_words)).tolist()]
    return pa.RecordBatch.from_pydict({"text": texts})


def test_tasks_let_go_of_tokenizers():
    path, task = public_tokenizers.path("byte_bpe_50k.json"), lambda batches: batches
    Encoder.of(path)
    assert list(common.lean(task, encodes=True)(iter([1, 2]))) == [1, 2]
    assert path in vars(tokenizers)["_encoders_of_jobweir"]
    assert list(common.lean(task)(iter([1, 2]))) == [1, 2]
    assert "_encoders_of_jobweir" not in vars(tokenizers)


def test_stretches(monkeypatch):
    monkeypatch.setattr(common, "STRETCH", 10)
    b = pa.RecordBatch.from_pydict({"i": [*range(7)], "t": ["", "x" * 30, "ab", None, "ü" * 4, "c", ""], "u": [""] * 7})
    cut = [x.column(0).to_pylist() for x in common.stretches([b.slice(0, 0), b], 1, 2)]
    assert cut == [[0], [1], [2, 3, 4], [5, 6]]


def test_memory_of_counting_frequent_shingles():
    batches = [batch(1000, 700), batch(1000, 700)]
    tracemalloc.start()
    found = list(nd._frequent_here(0.001)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # two texts of 5 MB, 1.4 million shingles
    assert sum(x.num_rows for x in found) == 1000 * 696  # each is in two texts
