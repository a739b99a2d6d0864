"""Tokens, packing and token files."""

import io
import math
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from jobweir.llm import packing, token_file as tf
from jobweir.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "\n", "  ", " \n", "\t", " ", "é", "'s", "!", "12", "<|endoftext|>", "\r\n", "。", "x" * 70, "\x1c", "\0", " \0abc"]
CASES = [(1, "Hello world. " * 700), (2, None), (3, ""), (4, "a b"), (4, "a b"), (4, "other"), (None, "no id"), (9, "x\n" * 3000)]


def ids(text):
    return Encoder.of(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_encoder_equals_the_library(parts):
    text = "".join(parts)
    assert Encoder.of(PATH).batch([text])[0] == np.array(ids(text), "<u4").tobytes()


def test_full_cache(monkeypatch):
    from jobweir.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 500)
    e = Encoder(PATH)
    for text in ("one two three four five", "six seven one two\neight", "six six"):
        assert e.batch([text])[0] == np.array(ids(text), "<u4").tobytes()
    assert len(e.cache) < 5 and e.held < 1000
    e = Encoder(PATH)
    long = "y" * 5000 + " z"
    assert e.batch([long])[0] == np.array(ids(long), "<u4").tobytes()
    assert "\0" + "y" * 5000 not in e.cache and "z" in e.cache


def test_pack(docs_of):
    got = packing.pack(docs_of(CASES), PATH).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in {i: t for i, t in CASES if i in (1, 2, 3, 9, None)}.items():
        want = ids(text) + [2]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert sum(r.length for r in mine) == len(want)
        assert all(r.length == 1024 for r in mine[1:])
        assert [r.ids_crc32 for r in mine] == [crc(want[r.start : r.start + r.length]) for r in mine]
    assert sum(r.doc_id == 4 for r in got) == 3
    total = sum(r.length for r in got)
    assert len(by_seq) == math.ceil(total / 1024)
    assert packing.pack(docs_of([]), PATH).collect() == []


def test_search_reaches_the_bound_or_near():
    g = random.Random(5)
    for case in range(12):
        counts = {}
        for _ in range(g.choice([30, 300, 3000])):
            n = g.choice([g.randint(1, 100), g.randint(300, 700), g.randint(1, 100)])
            counts[n] = counts.get(n, 0) + 1
        start = packing.best_fit(dict(counts), 100 if case % 3 == 0 and max(counts) <= 100 else 1024)
        before = start.count()
        done = packing.local_search(start)
        held = {}
        for p, n in done.groups.items():
            assert sum(p) <= done.room
            for x in p:
                held[x] = held.get(x, 0) + n
        assert held == counts
        bound = math.ceil(sum(k * v for k, v in counts.items()) / done.room)
        assert bound <= done.count() <= min(before, bound + max(2, bound // 20))


def fewest(lengths, room):
    """The least number of bins, by trying all ways."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= room and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def test_search_against_all_packings():
    """Small cases: at most one bin more than the fewest possible, and mostly none."""
    g, over = random.Random(11), 0
    for _ in range(150):
        room = g.choice([10, 20, 31])
        lengths = sorted((g.randint(1, room) for _ in range(g.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        extra = packing.plan(counts, room).count() - fewest(lengths, room)
        assert 0 <= extra <= 1
        over += extra
    assert over <= 2


def test_search_ends_only_when_stuck():
    """No move, exchange, two for one or one for two is left between any two bins."""
    g = random.Random(3)
    counts = {}
    for _ in range(2000):
        n = min(1024, max(1, int(g.lognormvariate(5.5, 0.8))))
        counts[n] = counts.get(n, 0) + 1
    done = packing.plan(counts, 1024)
    bound = math.ceil(sum(k * v for k, v in counts.items()) / 1024)
    if done.count() > bound:
        under = [p for p in done.groups if sum(p) < 1024]
        for b in under:
            for a in under:
                if sum(a) < sum(b) or a == b and done.groups[a] < 2:
                    continue
                gets = {(x,) for x in b} | {(b[i], b[j]) for i in range(len(b)) for j in range(i)}
                for y in {0, *a}:
                    assert not any(0 < sum(x) - y <= 1024 - sum(a) for x in gets)
                for y in packing.twos(a):
                    assert not any(0 < x - y <= 1024 - sum(a) for x in b)


def test_one_for_two():
    # neither a move, nor one for one, nor two for one helps these two bins
    bins = packing.Bins(20)
    for p in ((7, 6, 5), (9,), (3,) * 6 + (1,)):
        bins.put(p, 1)
    assert packing._swap(bins, (9,)) is not None
    assert packing.twos((7, 6, 5)) == {13: (7, 6), 12: (7, 5), 11: (6, 5)} and packing.twos((4, 4)) == {8: (4, 4)}


def test_moves():
    # best-fit decreasing needs three bins of 10 here; an exchange empties one
    bins = packing.Bins(10)
    for p in ((6, 3), (5, 4), (2,)):
        bins.put(p, 1)
    assert packing.local_search(bins).count() == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.floats(0, 0.99), st.integers(0, 32))
def test_block_round_trip(values, percentile, shift):
    x = (np.array(values, np.uint64) >> np.uint64(shift)).astype(np.uint32)
    blocks = tf.pack_blocks(x, percentile)
    assert len(blocks) == 1 and (tf.unpack_blocks(blocks[0], [0]) == x).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 32), st.randoms())
def test_blocks_round_trip(n, shift, r):
    g = np.random.default_rng(r.randrange(1 << 30))
    x = (g.integers(0, 1 << 32, n, dtype=np.uint64) >> g.integers(shift, 33, n, dtype=np.uint64)).astype(np.uint32)
    blocks = tf.pack_blocks(x)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1].tolist()
    assert len(blocks) == -(-n // tf.BLOCK)
    if n:
        assert (tf.unpack_blocks(b"".join(blocks), starts) == x).all()


def test_block_layout():
    """A block by hand: least 7, width 3, one exception."""
    x = np.array([7, 8, 9, 10, 14, 7, 7, 7, 7, 7, 7 + (5 << 3) + 1], np.uint32)
    data = tf.pack_blocks(x, 0.9)[0]
    assert data[:9] == (7).to_bytes(4, "little") + (11).to_bytes(2, "little") + bytes([3]) + (1).to_bytes(2, "little")
    bits = sum(v << (3 * i) for i, v in enumerate([0, 1, 2, 3, 7, 0, 0, 0, 0, 0, 1]))
    assert data[9:14] == bits.to_bytes(5, "little")
    assert data[14:] == (10).to_bytes(2, "little") + (5).to_bytes(4, "little")

def test_writer_and_reader():
    g = np.random.default_rng(2)
    docs = [(i, g.integers(0, 50_000, int(n), dtype=np.uint32)) for i, n in enumerate([0, 1, 1024, 5000, 3, 0, 2048])]
    out = io.BytesIO()
    w = tf.Writer(out)
    for i, x in docs:
        w.add([i if i else None], [x.tobytes()])
    w.close()
    got = list(tf.Reader(out).documents(step=1))
    assert [g[0] for g in got] == [i or None for i, _ in docs]
    assert all((a[2] == b[1]).all() for a, b in zip(got, docs))
    r = tf.Reader(out)
    assert (r.blocks(2, 4) == np.concatenate([x for _, x in docs])[2048:4096]).all()


def test_files(docs_of, spark):
    manifest = tf.write(docs_of(CASES), PATH)
    got = sorted(tf.read(spark, manifest).collect(), key=lambda r: r.start)
    hashed = docs_of(CASES).selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()
    order = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    at = 0
    for r, (i, text) in zip(got, order, strict=True):
        want = ids(text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), crc(want))
        at += len(want)
    assert tf.read(spark, tf.write(docs_of([]), PATH)).collect() == []
