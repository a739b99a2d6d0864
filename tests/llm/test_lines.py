"""Line dedup: against a plain computation, and reversibility."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobweir.llm import line_dedup as ld

LONG = "A line that is long enough to count"
CASES = [
    (1, f"{LONG}\nshort\n{LONG}"),
    (2, f"  {LONG.upper()}\t\nown line of the second document"),
    (3, f"x\n{LONG}\r"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, f"Élan {LONG}\nélan {LONG}"),
    (None, LONG),
    (8, f"twice in two documents only\n{'y' * 20}"),
    (9, f"twice in two documents only\n{'y' * 20}"),
    (9, f"twice in two documents only\n{'y' * 20}"),
    (9, f"another version\n{'z' * 19}"),
]


def key(line):
    x = line.strip(" \t\n\x0b\f\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def plain(rows, least=20, docs=3):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = {x for x in held[key(line)] if x is not None}
            if not (len(key(line)) >= least and len(ids) >= docs and i != max(ids)):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()], key=repr)


def test_cases(docs_of):
    out = ld.dedup(docs_of(CASES))
    assert rows(out) == plain(CASES)
    assert out.columns == ["doc_id", "text", "th", "pos", "label", "n_lines", "n_dropped"]
    assert ld.dedup(docs_of([])).collect() == []


def test_clashing_columns_and_long_texts(spark):
    long = "\n".join(f"{LONG} {i}" for i in range(20_000)) + "\n" + "z" * 500_000
    cases = [(i, long if i < 4 else f"own {i} " + "w" * 100_000) for i in range(6)]
    names = ["doc_id", "text", "_id", "_th", "_drop", "gone", "gone_id", "h", "g"]
    docs = spark.createDataFrame(
        [(i, t, 1, 2, 3, 4, 5, 6, 7) for i, t in cases], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:])
    )
    out = ld.dedup(docs)
    assert out.columns == [*names, "n_lines", "n_dropped"]
    assert rows(out) == plain(cases)


@pytest.mark.parametrize("size", [200_000, 2])
def test_filters_by_shard(docs_of, monkeypatch, size):
    """Filters that are too large to send, with lines in one and in many groups."""
    monkeypatch.setattr(ld, "FILTER_BYTES", -1)
    monkeypatch.setattr(ld, "GROUP_LINES", size)
    assert rows(ld.dedup(docs_of(CASES))) == plain(CASES)


def test_a_batch_is_cut_against_the_corpus(docs_of, monkeypatch):
    """Random inserts and deletes: every document is then cut as if all were counted anew."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 5)
    g = random.Random(6)
    pool = [f"{LONG} {i}" for i in range(25)]
    new = lambda i: (i, "\n".join(g.sample(pool, g.randint(1, 6)) + [f"only here {i} {g.random()}"]))
    held = [new(i) for i in g.sample(range(100), 12)]
    state, shards = ld.insert(ld.empty_state(docs_of(held)), docs_of(held)), set()
    for turn in range(3):
        more = [new(i) for i in g.sample([i for i in range(100) if i not in {i for i, _ in held}], 8)]
        gone = g.sample(held, 7)
        state = ld.insert(state, docs_of(more))
        state = ld.delete(state, docs_of(gone))
        held = [x for x in held if x not in gone] + more
        shards.add(state.n_shards)
    assert max(shards) > 1
    want = {r[0]: r for r in plain(held)}
    some = held[:3]
    assert rows(ld.dedup(docs_of(some), state)) == sorted((want[i] for i, _ in some), key=repr)
    assert rows(ld.dedup(docs_of(held), state)) == plain(held)
    refs = {(r.h, r.g): (r.n_docs, r.keeper) for r in state.refs.collect()}
    again = ld.insert(ld.empty_state(docs_of(held)), docs_of(held)).refs.collect()
    assert refs == {(r.h, r.g): (r.n_docs, r.keeper) for r in again}


def test_filters_grow(docs_of, spark):
    """Ten keys first, then thousands: shards are built anew, and the stash stays small."""
    def batch(lo, hi):
        return docs_of([(i * 10 + k, "\n".join(f"{LONG} {j}" for j in range(lo, hi))) for i in range(3) for k in [lo]])

    state = ld.insert(ld.empty_state(batch(0, 1)), batch(0, 10))
    state = ld.insert(state, batch(10, 3010))
    filters = state.filters.collect()
    assert sum(r.held for r in filters) == 3010
    assert sum(len(r.stash) // 8 for r in filters) <= 30
    assert all(r.held <= ld.FULL * r.n_buckets * ld.SLOTS for r in filters)


def test_a_filter_built_at_once():
    for n in (0, 1, 7, 1000, 60_000):
        keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        f = ld.Cuckoo.of(np.unique(keys))
        assert f.held == len(np.unique(keys)) and len(f.stash) <= n // 100
        if n:
            assert ld.Filters.of([f.row(0)], 1).hold(keys, np.zeros(n, np.int64)).all()
            for k in np.unique(keys)[::2][:200].tolist():
                f.remove(k)
            rest = np.setdiff1d(keys, np.unique(keys)[::2][:200])
            assert not len(rest) or ld.Filters.of([f.row(0)], 1).hold(rest, np.zeros(len(rest), np.int64)).all()


def test_delete_takes_an_insert_back(docs_of):
    a = [(i, f"{LONG} {i % 4}\nalone {i} alone alone alone") for i in range(12)]
    b = [(i, f"{LONG} {i % 4}\nalso something new in here {i % 2}") for i in range(12, 24)]
    both = docs_of(a + b)
    start = ld.insert(ld.empty_state(both), docs_of(a))
    full = ld.insert(start, docs_of(b))
    assert rows(ld.dedup(both, full)) == plain(a + b)
    back = ld.delete(full, docs_of(b))
    count = lambda s: sorted((r.h, r.g, r.n_docs) for r in s.refs.collect())
    assert count(back) == count(start)
    assert rows(ld.dedup(docs_of(a), back)) == plain(a)
    # what fell below the threshold has left the filter
    filters = ld.Filters.of(back.filters.collect(), back.n_shards)
    gone = [(h, g) for h, g, n in count(full) if n >= 3 and (h, g) not in {x[:2] for x in count(start)}]
    h, g = (np.array(x, np.int64) for x in zip(*gone))
    assert not filters.hold(h, g).any()


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=400), st.integers(2, 6))
def test_cuckoo_holds_all_it_was_given(keys, size):
    f = ld.Cuckoo(1 << size)
    keys = sorted(keys)
    for k in keys:
        f.add(k)
    for k in keys[::2]:
        f.remove(k)
    left = np.array(keys[1::2], np.int64)
    row = f.row(0)
    assert ld.Filters.of([row], 1).hold(left, np.zeros(len(left), np.int64)).all()
    for k in keys[1::2]:
        f.remove(k)
    assert not f.slots.any() and not f.stash


def test_hash_of_kept_text(docs_of, spark):
    from pyspark.sql import functions as F

    got = ld.dedup(docs_of(CASES[:3])).select("doc_id", F.sha2("text", 256).alias("s")).collect()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in plain(CASES[:3])}
    assert {r.doc_id: r.s for r in got} == want


def test_a_batch_writes_runs_of_its_own(docs_of, monkeypatch):
    """Earlier tables stay as they are; RUNS of them are merged."""
    monkeypatch.setattr(ld, "RUNS", 3)
    files = lambda df: {f: os.path.getmtime(f[7:]) for f in df.inputFiles()}
    a = [(i, f"{LONG} {i % 40}\n{LONG} own {i}") for i in range(200)]
    state = ld.insert(ld.empty_state(docs_of(a)), docs_of(a))
    before = [files(r) for r in (*state.line_runs, *state.ref_runs)]
    b = [(200 + i, f"{LONG} {i}\n{LONG} new") for i in range(3)]
    for k in range(2):
        state = ld.insert(state, docs_of(b[: 2 + k]))
        assert len(state.line_runs) == len(state.ref_runs) == 2 + k
    assert [files(state.line_runs[0]), files(state.ref_runs[0])] == before
    assert state.line_runs[1].count() == 4 and state.ref_runs[1].count() == 3
    state = ld.delete(ld.insert(state, docs_of([(900, None), (None, LONG), (901, "")])), docs_of(b[:2]))
    assert len(state.line_runs) < 3
    again = [(i, t) for i, t in a + b[2:]] + b[:2]
    held = ld.insert(ld.empty_state(docs_of(again)), docs_of(again))
    want = {(r.h, r.g): (r.n_docs, r.keeper) for r in held.refs.collect()}
    assert {(r.h, r.g): (r.n_docs, r.keeper) for r in state.refs.collect()} == want
    assert state.n_repeated == sum(n >= 3 for n, _ in want.values()) == sum(r.held for r in state.filters.collect())
