"""Ranked lexical search: exact inner products of sparse vectors, by ball trees.

An item's score of a document is an inner product: the item's side holds the
weight of each of its terms, times its repeats, and the document's side the
saturated term counts, both as whole numbers. Documents are projected onto the
items' terms as their texts are read; all that follows works on these short
vectors. Each task builds trees over its documents: a node halves its documents
along the line between two that lie far apart, and keeps their centroid, their radius and, for every term, how far they reach beyond the
centroid along its axis. An item's products with a node's documents are at most
its product with the centroid plus its length times the radius, and plus its
product with the reaches, which is the closer bound where documents are unlike
each other. Subtrees are visited best bound first and left when the bound is
under the score that an item's k-th document already has. Bounds are doubles, widened by far more than their
rounding errors; leaves are scored in 64-bit integers, so results are exact.

Items are searched in blocks of bounded size. Before all documents are searched,
the k-th best scores among one in SEED of them are found in the same way. They
can only be lower than the final ones, so searches that begin from them lose no
document and few tasks return documents that do not last.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, whole, written

#: Items, and bytes of their texts, that are searched at a time: what is sent to
#: tasks is bounded by them.
ITEMS, ITEM_BYTES = 2000, 1 << 20
#: Terms of documents in a tree, at most, and documents in a leaf.
TREE_TERMS, LEAF = 500_000, 16
#: Numbers in a tree's centroids, at most: leaves grow with the items' terms.
CENTROIDS = 1 << 23
#: One in so many documents gives the scores that the search begins from.
SEED = 32
#: Added to bounds, as a share: doubles err by less than 1e-12 here.
SLACK = 1e-9

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """The terms of a text: runs of ASCII letters (lower-cased), digits and
    characters beyond ASCII, as UTF-8."""
    return TERM.findall(text.encode().lower())


# --- the tree ---------------------------------------------------------------


class Docs(NamedTuple):
    """Sparse vectors in rows: row i has columns at[starts[i]:starts[i + 1]]."""

    ids: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    values: np.ndarray

    def taken(self, rows: np.ndarray) -> "Docs":
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Docs(self.ids[rows], starts, self.at[places], self.values[places])

    def dots(self, dense: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Products of all rows with a dense vector; no row is empty."""
        of = self.values if values is None else values
        return np.add.reduceat(dense[self.at] * of, self.starts[:-1]) if len(self.ids) else np.zeros(0)


class Tree(NamedTuple):
    """Nodes in the order they were made; docs lie in the order of the leaves."""

    docs: Docs
    first: list[int]
    last: list[int]
    children: list[tuple[int, int] | None]
    centroids: np.ndarray
    radii: np.ndarray
    tops: np.ndarray  # centroids plus reaches


def build(docs: Docs, scale: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree over docs, whose columns count scale times as much."""
    n_terms = len(scale)
    order = np.arange(len(docs.ids))
    first, last, children, centroids, radii, tops = [0], [len(order)], [None], [], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        part = docs.taken(order[a:b])
        y = part.values * scale[part.at]
        center = np.bincount(part.at, y, n_terms) / (b - a)
        squares = np.add.reduceat(y * y, part.starts[:-1])
        here = center @ center
        apart = squares - 2 * part.dots(center, y) + here
        # squares may cancel: the radius is widened by their rounding error
        radii.append(math.sqrt(max(float((apart + SLACK * SLACK * 1e3 * (squares + here)).max()), 0.0)))
        centroids.append(center)
        reach = np.zeros(n_terms)
        np.maximum.at(reach, part.at, y - center[part.at])
        tops.append(center + reach)
        if b - a > leaf and radii[-1] > 0:
            one = int(apart.argmax())

            def row(i):
                s = slice(part.starts[i], part.starts[i + 1])
                return np.bincount(part.at[s], y[s], n_terms)

            p = row(one)
            other = int((squares - 2 * part.dots(p, y)).argmax())
            side = part.dots(p - row(other), y)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, half)]
            children[at] = (len(first), len(first) + 1)
            first += [a, a + half]
            last += [a + half, b]
            children += [None, None]
        at += 1
    return Tree(docs.taken(order), first, last, children, np.array(centroids), np.array(radii), np.array(tops))


class Found:
    """The best k documents of an item so far, and the score that others need."""

    def __init__(self, k: int, need: int):
        self.k, self.need = k, need
        self.heap: list[tuple[int, int, int]] = []  # score, minus id (null: least), id

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, -(1 << 64) if doc_id is None else -doc_id, doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.need = max(self.need, self.heap[0][0])


def search(tree: Tree, query: np.ndarray, used: np.ndarray, scale: np.ndarray, found: Found) -> int:
    """Adds to found what tree holds for a query (whole numbers by column, those
    in used are not 0); how many leaves were scored."""
    scaled = query[used] / scale[used]
    length = math.sqrt(float(scaled @ scaled))
    balls = tree.centroids[:, used] @ scaled + length * tree.radii
    bounds = np.minimum(balls, tree.tops[:, used] @ scaled) * (1 + SLACK) + 1
    queue, scored = [(-bounds[0], 0)], 0
    docs = tree.docs
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < found.need:
            break
        if tree.children[node] is not None:
            for c in tree.children[node]:
                if bounds[c] >= found.need:
                    heapq.heappush(queue, (-bounds[c], c))
            continue
        scored += 1
        a, b = tree.first[node], tree.last[node]
        s = slice(docs.starts[a], docs.starts[b])
        got = np.add.reduceat(query[docs.at[s]] * docs.values[s], docs.starts[a:b] - docs.starts[a])
        for i in np.flatnonzero(got >= max(found.need, 1)):
            doc_id = docs.ids[a + i]
            if got[i] >= found.need:
                found.add(int(got[i]), doc_id)
    return scored


# --- Spark ------------------------------------------------------------------


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (item id, its terms with repeats), each of bounded size."""
    rows = items.select(F.col(id_col).alias("item_id"), whole(text_col).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, -(-size["n"] // ITEMS), -(-(size["b"] or 0) // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for i in range(n if size["n"] else 0):
        counted: dict = {}
        for r in rows.where(block == i).toLocalIterator():
            counted.setdefault(r["item_id"], Counter()).update(terms(r["text"]))
        yield counted


def _projected(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """By document with any of the terms: their places and counts, and n; besides,
    a row without a place for each task: its documents, terms, and counts of documents."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def project(batches):
        known = sent.value
        n_docs = n_terms = 0
        df = np.zeros(len(known), np.int64)
        for b in batches:
            ids, ns, at, tf = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = TERM.findall(text.as_py().encode().lower())
                if not words:
                    continue
                n_docs += 1
                n_terms += len(words)
                counts = Counter(words)
                mine = sorted((known[w], c) for w, c in counts.items() if w in known)
                if mine:
                    ids.append(doc_id)
                    ns.append(len(words))
                    at.append([i for i, _ in mine])
                    tf.append([c for _, c in mine])
                    df[at[-1]] += 1
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(ns, pa.int64()),
                        pa.array(at, pa.list_(pa.int32())),
                        pa.array(tf, pa.list_(pa.int64())),
                        pa.nulls(len(ids), pa.int64()),
                    ],
                    names=["doc_id", "n", "at", "tf", "n_docs"],
                )
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()),
                    pa.array([n_terms], pa.int64()),
                    pa.array([np.flatnonzero(df)], pa.list_(pa.int32())),
                    pa.array([df[df > 0]], pa.list_(pa.int64())),
                    pa.array([n_docs], pa.int64()),
                ],
                names=["doc_id", "n", "at", "tf", "n_docs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(project, "doc_id long, n long, at array<int>, tf array<long>, n_docs long")


class _Side(NamedTuple):
    """What tasks need to search for a block of items."""

    n_docs: int
    n_terms: int
    scale: np.ndarray
    queries: list  # by item: places and weights times repeats
    needs: list


def _search(vectors: DataFrame, side: _Side, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k documents of each item."""
    sent = vectors.sparkSession.sparkContext.broadcast(tuple(side))

    def task(batches):
        n_docs, n_terms, scale, queries, needs = sent.value
        found = [Found(k, need) for need in needs]
        dense = np.zeros(len(scale), np.int64)

        def look(parts):
            ids = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([p[1] for p in parts])
            n = np.concatenate([p[2] for p in parts])
            at = np.concatenate([p[3] for p in parts])
            tf = np.concatenate([p[4] for p in parts])
            m = 75 + np.array([25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            value = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            leaf = max(LEAF, 4 * len(ids) * len(scale) // CENTROIDS)
            tree = build(Docs(ids, np.concatenate([[0], np.cumsum(sizes)]), at, value), scale, leaf)
            for (places, w), best in zip(queries, found):
                dense[places] = w
                search(tree, dense, places, scale, best)
                dense[places] = 0

        parts, held = [], 0
        for b in batches:
            lists = b.column(2)
            if not len(lists):
                continue
            ids = np.array(b.column(0).to_pylist(), object)
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            parts.append((ids, sizes, b.column(1).to_numpy(), at, b.column(3).flatten().to_numpy(zero_copy_only=False)))
            held += len(at)
            if held >= TREE_TERMS:
                look(parts)
                parts, held = [], 0
        if parts:
            look(parts)
        out = [(i, e[2], e[0]) for i, best in enumerate(found) for e in best.heap]
        item, doc_id, score = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return vectors.select("doc_id", "n", "at", "tf").mapInArrow(task, "item int, doc_id long, score long")


def ranked(
    items: DataFrame,
    docs: DataFrame,
    k: int = 20,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Defined cases: null texts have no term; rows that repeat an item's id are one
    item with the terms of all; each row of docs is a document, also where an id
    repeats (equal scores of one id take ranks of their own); a null id of a
    document comes after the others at equal scores; documents are of any
    length; other columns are ignored; empty tables, or items without a term
    that any document has, give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = items.schema[item_col].dataType
    out = None
    for counted in _blocks(items, item_col, text_col):
        vocabulary = sorted(set().union(*counted.values()))
        if not vocabulary:
            continue
        table = written(_projected(docs, vocabulary, id_col, text_col), "search-vectors")
        totals = table.where(F.col("n_docs").isNotNull())
        size = totals.agg(F.sum("n_docs").alias("n"), F.sum("n").alias("l")).first()
        if not size["n"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        pairs = F.explode(F.arrays_zip("at", "tf")).alias("p")
        for r in totals.select(pairs).groupBy(F.col("p.at").alias("at")).agg(F.sum("p.tf").alias("df")).collect():
            df[r["at"]] = r["df"]
        w = weights(size["n"], df)
        place = {t: i for i, t in enumerate(vocabulary)}
        names, queries = [], []
        for item_id, c in counted.items():
            mine = sorted((place[t], r * int(w[place[t]])) for t, r in c.items() if w[place[t]] > 0)
            if mine:
                names.append(item_id)
                queries.append((np.array([p for p, _ in mine]), np.array([v for _, v in mine], np.int64)))
        # rare terms decide where documents lie: radii then hold what items score by
        side = _Side(size["n"], size["l"], np.maximum(w, 1).astype(float), queries, [0] * len(names))
        vectors = table.where(F.col("n_docs").isNull())
        part = F.pmod(F.xxhash64("doc_id", "n", "at"), F.lit(SEED)) == 0
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        seeds = _search(vectors.where(part), side, k).withColumn("rank", F.row_number().over(best)).where(f"rank = {k}")
        needs = {r["item"]: r["score"] for r in seeds.collect()}
        side = side._replace(needs=[needs.get(i, 0) for i in range(len(names))])
        found = _search(vectors, side, k).withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
        named = spark.createDataFrame(
            list(enumerate(names)), f"item int, item_id {id_type.simpleString()}"
        )
        block = found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = block if out is None else out.unionByName(block)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return out
