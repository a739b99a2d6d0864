"""Near-duplicates: consistent weighted sampling over TF-IDF shingles.

1. Counts. How many documents hold each frequent shingle (a share of COMMON of
   all documents or more): every task reports shingles that are frequent among
   the documents it has read, which misses none that is frequent overall; a
   second pass counts these exactly over all documents. The table has at most
   (mean shingles of a document) / COMMON rows, whatever the corpus.
2. Weights. tf * (1 + IDF * idf), idf falling from 1 at COMMON and below to 0
   for a shingle of all documents. IDF is a parameter, low by default: with 1 or
   more, the few shingles that an edit makes (in one document only) outweigh
   what thousands of near copies share, and copies fall below the threshold.
3. Samples. Improved consistent weighted sampling (Ioffe, 2010) draws K samples
   from each text; two texts agree in a sample with their weighted Jaccard
   similarity. Bands of ROWS samples name the buckets of a text: the K samples
   are dealt into bands DEALS times, in different orders, so that bands can be
   long, which keeps texts apart that merely share a passage, and yet miss a
   pair at the threshold less than once in a thousand. Equal texts have equal
   samples and meet before any comparison.
4. Links. In small buckets all pairs meet. In a crowded one of the first deal,
   what most members have in each sample is taken as its consensus: about the
   samples of the text or passage that brought them together. All members meet
   two leaders: the one with the most links so far and the purest copy, which has
   the most of the consensus for its size. This joins most copies.
5. The rest of crowded buckets, exactly. Texts in crowded buckets that are not of
   one class by then go by the rarest of their shingles: shingles are ordered by
   weight, rare ones first, then by hash, and a text is posted under those before
   which less than 1 - threshold of its weight lies. Two texts that reach the
   threshold share one of them, and by what lies behind the first that they share
   most other pairs are ruled out (prefix and position filter of similarity
   joins). What a crowd shares is frequent, so it comes last. Members of crowded
   postings meet two leaders once more; then all pairs of different classes in
   them meet, without those inside a posting's largest class.
6. Pairs of one class are passed over, and those whose total weights or samples
   rule the threshold out (samples by five standard deviations); all others are
   verified by their exact weighted Jaccard similarity.
7. Classes. Links join texts to classes; class_id is the least id in a class.

Skew: a bucket may hold a third of all texts. Consensus and leaders are
combinable aggregates of fixed size, members meet leaders and each other by equi
joins of tables, which adaptive execution splits.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, lean, small_batches, stretches, whole, written
from .shingles import Shingler, mix

COMMON = 0.01
IDF = 0.25
K, ROWS, DEALS = 60, 6, 4
GROUP = 1_000_000
#: Most frequent shingles that are sent to every task while they are counted;
#: more than that are counted by a join.
SENT = 2_000_000
#: Ids of texts in likely pairs (24 bytes each) up to which they are sent to
#: every task; more are met by a shuffle join.
NEED = 1_000_000
#: Bits that are kept of each sample for the comparison in joins.
PLANES = 8
#: Buckets of so many members or fewer have all their pairs tried at once; larger
#: ones go by leaders, then by the rarest shingles of their members.
SMALL = 32
LINK = "u long, v long, similarity double"
#: Postings before one that are kept with it, so that pairs are not met again and again.
BEFORE = 8
POSTED = ["bucket", "node", "rest", "last"]


# --- counts of frequent shingles --------------------------------------------


def _frequent_here(share: float):
    """Shingles in a share of the documents of a stretch of this task's input.

    What is frequent overall is so in one stretch at least, whatever their
    sizes. A stretch goes on until its share is two documents or more, and the
    last one takes in what is left, so that only a task of fewer documents in
    all reports shingles of a single one.
    """

    def run(batches):
        shingler, held, n_docs, n = Shingler(), [], 0, 0
        before = None

        def frequent(held, n_docs):
            h = np.concatenate(held)
            held.clear()
            h.sort()
            times = max(1, math.ceil(share * n_docs - 1e-9))
            starts = h[: max(0, len(h) - times + 1)]
            found = np.unique(starts[starts == h[times - 1 :]]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

        for b in stretches(batches, 0):
            h, _, _ = shingler.counted([t.as_py() for t in b.column(0)])
            held, n_docs, n = held + [h], n_docs + b.num_rows, n + len(h)
            if n >= GROUP and share * n_docs >= 2:
                if before:
                    yield frequent(*before)
                before, held, n_docs, n = (held, n_docs), [], 0, 0
        if before:
            held, n_docs, before = before[0] + held, before[1] + n_docs, None
        if held:
            yield frequent(held, n_docs)

    return run


def _count_these(sent):
    def run(batches):
        shingler, wanted = Shingler(), sent.value
        total = np.zeros(len(wanted), np.int64)
        for b in stretches(batches, 0):
            h = shingler.counted([t.as_py() for t in b.column(0)])[0].view(np.int64)
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            np.add.at(total, at[wanted[at] == h], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(wanted[some]), pa.array(total[some])], names=["h", "n"]
        )

    return run


def _all_shingles(batches):
    shingler = Shingler()
    for b in stretches(batches, 0):
        h = shingler.counted([t.as_py() for t in b.column(0)])[0].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])


def frequent_shingles(texts: DataFrame, n_docs: int, share: float = COMMON) -> DataFrame:
    """(h, n): shingles that share * n_docs documents or more hold, and how many do.

    A shingle over one document only is never frequent.
    """
    spark = texts.sparkSession
    maybe = written(texts.mapInArrow(lean(_frequent_here(share)), "h long").distinct(), "frequent")
    if maybe.count() <= SENT:
        wanted = np.sort(maybe.toArrow().column("h").to_numpy())
        if not len(wanted):
            return spark.createDataFrame([], "h long, n long")
        sent = spark.sparkContext.broadcast(wanted)
        counts = texts.mapInArrow(lean(_count_these(sent)), "h long, n long")
    else:
        counts = (
            texts.mapInArrow(lean(_all_shingles), "h long").join(maybe, "h", "left_semi")
            .select("h", F.lit(1).alias("n"))
        )
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, share * n_docs))


class Weights:
    """Weights of shingles: top = 1 + idf where rare, w less where frequent (h, sorted)."""

    def __init__(self, h: np.ndarray, w: np.ndarray, top: float):
        self.h, self.w, self.top = h, w, top

    def plain(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What Weights(*plain) makes again: workers get no class of this package."""
        return self.h, self.w, self.top

    @classmethod
    def of(cls, texts: DataFrame, share: float = COMMON, idf: float = IDF) -> "Weights":
        n_docs = texts.count()
        found = frequent_shingles(texts, n_docs, share).toArrow()
        h = found.column("h").to_numpy().view(np.uint64)
        n = found.column("n").to_numpy().astype(np.float64)
        order = np.argsort(h)
        rare = np.log(np.maximum(n_docs, n) / n) / math.log(1 / share)
        return cls(h[order], 1 + idf * np.minimum(1, rare[order]), 1 + idf)

    def __call__(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = np.full(len(h), self.top)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            same = self.h[at] == h
            w[same] = self.w[at[same]]
        return w * times


# --- consistent weighted sampling -------------------------------------------


class Sampler:
    """K samples of weighted sets. The random r, c and b of an element and a
    sample come from tables of quantiles, indexed by bits of the mixed hash."""

    def __init__(self, k: int = K, seed: int = 7):
        g = np.random.default_rng(seed)
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        gamma = self._gamma2(u)
        self.r = gamma.astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.seeds = g.integers(0, 1 << 63, k, dtype=np.uint64)

    @staticmethod
    def _gamma2(u: np.ndarray) -> np.ndarray:
        """Quantiles of Gamma(2, 1): its distribution is 1 - (1 + x) exp(-x)."""
        lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - (1 + x) * np.exp(-x) < u
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        return (lo + hi) / 2

    def samples(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of K 32-bit samples for each set; sets start at starts.

        A sample is the least value ln(a) of the set, which names its element
        and weight step.
        """
        out = np.empty((len(starts), len(self.seeds)), np.float32)
        log_w = np.log(weight).astype(np.float32)
        for k, seed in enumerate(self.seeds):
            x = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            bits = x.view(np.uint16).reshape(-1, 4)
            r = self.r[bits[:, 3]]
            b = bits[:, 1] * np.float32(1 / (1 << 16))
            t = np.floor(log_w / r + b)
            t -= b
            t += 1
            t *= r
            np.subtract(self.log_c[bits[:, 2]], t, out=t)
            out[:, k] = np.minimum.reduceat(t, starts)
        return out.view(np.int32)


def dealt(k: int, rows: int, deals: int) -> list[list[int]]:
    """The samples of each band: k // rows bands for each of so many orders."""
    bands = []
    for seed in range(deals):
        order = np.random.default_rng(seed).permutation(k).tolist()
        bands += [sorted(order[i : i + rows]) for i in range(0, k - rows + 1, rows)]
    return bands


#: Elements that are sampled together, so that their arrays stay in the cache.
CHUNK = 32_000


def _sample_texts(sent, k: int):
    def run(batches):
        shingler, sampler, weights = Shingler(), Sampler(k), Weights(*sent.value)
        for b in stretches(batches, 3):
            h, doc, times = shingler.counted([t.as_py() for t in b.column(3)])
            w = weights(h, times)
            size = pa.array(np.bincount(doc, w, b.num_rows).astype(np.float64))
            has, starts = np.unique(doc, return_index=True)
            found = np.zeros((len(has), k), np.int32)
            ends = np.append(starts[1:], len(h))
            i = 0
            while i < len(has):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
                lo, hi = starts[i], ends[j - 1]
                found[i:j] = sampler.samples(h[lo:hi], w[lo:hi], starts[i:j] - lo)
                i = j
            row = np.full(b.num_rows, -1)
            row[has] = np.arange(len(has))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(has) + 1, dtype=np.int32) * k), pa.array(found.ravel())
            )
            take = pa.array(row, mask=row < 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), size, lists.take(take)],
                names=["doc_id", "a", "b", "size", "samples"],
            )

    return run


# --- verification -----------------------------------------------------------


def similarities(shingler: Shingler, weights: Weights, left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; without words, 0."""
    n = len(left)
    h, doc, times = shingler.counted(left + right)
    w = weights(h, times)
    sums = np.bincount(doc, w, 2 * n)
    key = mix(h + (doc % max(n, 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cut = int(np.searchsorted(doc, n))
    order = np.argsort(key[cut:])
    there = key[cut:][order]
    both = np.zeros(n)
    if len(there) and cut:
        at = np.minimum(np.searchsorted(there, key[:cut]), len(there) - 1)
        same = there[at] == key[:cut]
        shared = np.minimum(w[:cut][same], w[cut:][order[at[same]]])
        both = np.bincount(doc[:cut][same], shared, n)
    union = sums[:n] + sums[n:] - both
    return np.divide(both, union, out=np.zeros(n), where=union > 0)


def _verify(sent, threshold: float):
    def run(batches):
        shingler, weights = Shingler(), Weights(*sent.value)
        for b in stretches(batches, 2, 3):
            s = similarities(
                shingler, weights, [t.as_py() for t in b.column(2)], [t.as_py() for t in b.column(3)]
            )
            ok = pa.array(s >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s)], names=["u", "v", "similarity"]
            ).filter(ok)

    return run


def _rarest(sent, threshold: float):
    """(bucket, node, rest, last) of texts (node, text): the shingles that a text
    is posted under, the weight of it that this one and those behind it hold, and
    those before it, at most so many as BEFORE."""

    def run(batches):
        shingler, weights = Shingler(), Weights(*sent.value)
        for b in stretches(batches, 1):
            h, doc, times = shingler.counted([t.as_py() for t in b.column(1)])
            one = weights(h, 1)
            order = np.lexsort((h, -one, doc))
            h, doc, w = h[order], doc[order], (one * times)[order]
            size = np.bincount(doc, w, b.num_rows)
            first = np.searchsorted(doc, doc)
            before = np.cumsum(w) - w
            rest = size[doc] - (before - before[first])
            kept = np.flatnonzero(rest >= (threshold - 1e-6) * size[doc])
            h = h.view(np.int64)
            n = np.minimum(kept - first[kept], BEFORE)
            ends = np.cumsum(n)
            at = np.repeat(kept - ends, n) + np.arange(n.sum())
            last = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(h[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[kept]), b.column(0).take(pa.array(doc[kept])), pa.array(rest[kept]), last],
                names=POSTED,
            )

    return run


# --- links ------------------------------------------------------------------


def planes(samples: Column, k: int) -> Column:
    """PLANES bits of each of k samples, as longs that hold a bit of 64 samples."""
    mixed = F.transform(samples, lambda x: F.xxhash64(x))

    def plane(at: int, bit: int) -> Column:
        def add(acc, x):
            return F.shiftleft(acc, 1).bitwiseOR(F.shiftright(x, bit).bitwiseAND(F.lit(1).cast("long")))

        return F.aggregate(F.slice(mixed, at + 1, 64), F.lit(0).cast("long"), add)

    longs = [plane(at, bit) for at in range(0, k, 64) for bit in range(PLANES)]
    return F.array(*longs)


def _spots(k: int) -> list[tuple[int, int]]:
    """(long of a plane, bit in it) of each of k samples, in planes()."""
    return [(j // 64, min(64, k - j // 64 * 64) - 1 - j % 64) for j in range(k)]


class Search:
    """Links found so far, and the classes that they make.

    nodes: (node, least, a, b, samples), one row a text. source: the texts.
    """

    def __init__(self, source: DataFrame, nodes: DataFrame, weights, threshold: float, k: int):
        self.weights, self.threshold, self.k = weights, threshold, k
        self.enough = threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)
        self.nodes = written(
            nodes.select("node", "samples", "size", planes(F.col("samples"), k).alias("planes")), "planes"
        )
        # texts are hashed only where the id is needed, so the hashes are no join keys
        need = nodes.select("node", "least", F.col("a").alias("na"), F.col("b").alias("nb"))
        same = (F.col("a").bitwiseXOR(F.col("na")) == 0) & (F.col("b").bitwiseXOR(F.col("nb")) == 0)
        found = source.join(self._small(need), (F.col("doc_id") == F.col("least")) & same)
        self.texts = written(found.select("node", "text"), "texts")
        self.links = self.tried = None
        self.labels = self.nodes.select("node", F.col("node").alias("label"))

    @staticmethod
    def _small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= NEED else table

    def likely(self, p: str, q: str) -> Column:
        """Whether planes p and q leave it open that enough samples agree."""
        apart = F.lit(0)
        for w in range(math.ceil(self.k / 64)):
            differ = F.lit(0).cast("long")
            for i in range(w * PLANES, (w + 1) * PLANES):
                differ = differ.bitwiseOR(F.col(p)[i].bitwiseXOR(F.col(q)[i]))
            apart = apart + F.bit_count(differ)
        return apart <= self.k - self.enough * self.k

    def members(self, left: DataFrame) -> DataFrame:
        """left (bucket, node, ...) with planes, size and label of each node."""
        return left.join(self.nodes.select("node", "planes", "size"), "node").join(self.labels, "node")

    def met(self, one: DataFrame, other: DataFrame, once: Column | None = None) -> DataFrame:
        """(u, v): who of one meets whom of other in a bucket, both as members()
        gives them, but pairs of one class, of sizes too far apart, or whose
        samples agree too little. once: which of the two ways a pair of members
        of both tables meets. Where both have rest, what lies behind a shared
        shingle must suffice; a pair that reaches the threshold meets under the
        first one that it shares, so not where it shares one of those before too."""
        posted = "rest" in one.columns and "rest" in other.columns
        other = other.select(*[F.col(c).alias(f"other_{c}") for c in other.columns])
        fits = F.least("size", "other_size") >= (self.threshold - 1e-6) * F.greatest("size", "other_size")
        if posted:
            need = (self.threshold - 1e-6) * (F.col("size") + F.col("other_size"))
            fits = fits & (F.least("rest", "other_rest") * (1 + self.threshold) >= need)
        return one.join(
            other,
            (F.col("bucket") == F.col("other_bucket")) & (F.col("label") != F.col("other_label")) & fits
            & (F.lit(True) if once is None else once)
            & self.likely("planes", "other_planes")
            & (~F.arrays_overlap("last", "other_last") if posted else F.lit(True)),
        ).select(F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v"))

    def verify(self, pairs: DataFrame) -> None:
        """Takes in the links among pairs (u, v)."""
        new = pairs.distinct()
        if self.tried is not None:
            new = new.join(self.tried, ["u", "v"], "left_anti")
        new = written(new, "likely")
        n = new.count()
        if not n:
            return
        ids = new.select(F.col("u").alias("node")).union(new.select("v")).distinct()
        texts = self.texts.join(F.broadcast(ids) if 2 * n <= NEED else ids, "node")
        found = written(
            new.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
            .join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
            .select("u", "v", "tu", "tv")
            .mapInArrow(lean(_verify(self.weights, self.threshold)), LINK),
            "links",
        )
        self.tried = new if self.tried is None else self.tried.unionByName(new)
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.labels = written(merged(self.labels, found, rounds=1), "labels")

    def consensus(self, crowded: DataFrame) -> DataFrame:
        """(bucket, middle): what most members have in each bit of the first two
        planes, so about the samples of what they share."""
        spots, held = _spots(self.k), sorted({w for w, _ in _spots(self.k)})
        sums = [
            F.sum(F.shiftright(F.col("planes")[w * PLANES + p], bit).bitwiseAND(1)).alias(f"s{p}_{w}_{bit}")
            for p in (0, 1) for w, bit in spots
        ]
        counted = crowded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), *sums)
        longs = []
        for p in (0, 1):
            for w in held:
                bits = F.lit(0).cast("long")
                for x, bit in spots:
                    if x == w:
                        most = (2 * F.col(f"s{p}_{w}_{bit}") > F.col("m")).cast("long")
                        bits = bits.bitwiseOR(F.shiftleft(most, bit))
                longs.append(bits)
        return counted.select("bucket", F.array(*longs).alias("middle"))

    def apart(self) -> list[Column]:
        """Longs whose bits say which samples differ from the consensus."""
        n = math.ceil(self.k / 64)
        return [
            F.col("planes")[w * PLANES].bitwiseXOR(F.col("middle")[w]).bitwiseOR(
                F.col("planes")[w * PLANES + 1].bitwiseXOR(F.col("middle")[n + w])
            )
            for w in range(n)
        ]

    def settle(self, left: DataFrame, lead: bool = True, last: bool = False) -> DataFrame | None:
        """Verifies pairs within the buckets of left, as crowding() gives it.

        Small buckets: all pairs. Crowded ones with lead: every member meets the
        one with the most links so far, or while there are none the purest: that
        which has the most of the consensus for its size; and the purest of those
        that have no link. last: all pairs of different classes. Returns the
        members (bucket, node, ...) of crowded buckets that are not settled
        then, None if there are none.
        """
        few = self.members(left.where(F.col("n") <= SMALL))
        pairs = self.met(few, few, F.col("node") < F.col("other_node"))
        many = left.where(F.col("n") > SMALL)
        if many.isEmpty():
            self.verify(pairs)
            return None
        if last:
            self.verify(pairs.unionByName(self.across(many)))
            return None
        if not lead:
            self.verify(pairs)
            return many
        many = written(many.join(self.nodes.select("node", "planes", "size"), "node"), "many")
        members = many.join(self.labels, "node")
        if "rest" in many.columns:  # what a posting holds is frequent: the lightest text is about that alone
            ranked, pure = members, -F.col("size")
        else:
            agree = self.k - sum((F.bit_count(x) for x in self.apart()), F.lit(0))
            ranked, pure = members.join(self.consensus(many), "bucket"), agree / F.col("size")
        links = F.lit(0)
        if self.links is not None:
            ends = self.links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
            ranked, links = ranked.join(ends, "node", "left"), F.coalesce("count", F.lit(0))
        near = F.struct(links, pure, F.xxhash64("node"))
        part = (F.col("label") == F.col("node")) & (links == 0)
        leaders = written(
            ranked.groupBy("bucket", part).agg(F.max_by("node", near).alias("node")).select("bucket", "node"), "leaders"
        )
        self.verify(pairs.unionByName(self.met(members, self.members(leaders))))
        # a bucket of one class is done
        open_ = many.join(self.labels, "node").groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high")
        ).where("low < high")
        left = written(many.drop("planes", "size").join(open_.select("bucket"), "bucket", "left_semi"), "left")
        return None if left.isEmpty() else left

    def across(self, many: DataFrame) -> DataFrame:
        """(u, v): all pairs in the buckets of many (bucket, node, rest) that met()
        lets through; those inside the largest class of a bucket are not looked at."""
        members = written(self.members(many), "across")
        classes_ = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
        main = classes_.groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
        main = main.select(F.col("bucket").alias("of"), "main")
        others = members.join(main, (F.col("bucket") == F.col("of")) & (F.col("label") != F.col("main")))
        return self.met(others.select(*members.columns), members)

    def split(self, left: DataFrame, level: int) -> DataFrame:
        """(bucket, node, rest, last): members of crowded buckets of bands (level 1) by
        their rarest shingles; crowded postings stay as they are."""
        if level > 1:
            return left
        texts = self.texts.join(left.select("node").distinct(), "node").select("node", "text")
        posted = lean(_rarest(self.weights, self.threshold))
        return written(texts.mapInArrow(posted, "bucket long, node long, rest double, last array<long>"), "rarest")


def shared(bands: DataFrame) -> DataFrame:
    """The rows of bands (bucket, node, ...) whose bucket has several members, as a table."""
    several = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return written(bands.join(several, "bucket", "left_semi"), "bands")


def crowding(bands: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """bands (bucket, node, ...) with n, the members of a bucket, as a table: of
    buckets of n > 1, with labels only those whose members are not of one class."""
    sizes = F.count(F.lit(1)).alias("n")
    if labels is None:
        open_ = bands.groupBy("bucket").agg(sizes).where("n > 1")
    else:
        ends = (F.min("label").alias("low"), F.max("label").alias("high"))
        open_ = bands.join(labels, "node").groupBy("bucket").agg(sizes, *ends).where("low < high").drop("low", "high")
    return written(bands.join(open_, "bucket"), "crowding")


def find_links(bands: DataFrame, search: Search) -> None:
    """Finds links of texts that share a bucket of bands (bucket, node, first),
    enough of them to join all that are linked. The first deal of bands goes
    first: it joins most copies, which share nearly all buckets. Of the other
    deals only the buckets count that are not of one class by then. Pairs that
    share crowded buckets only are found by the rarest shingles of their texts."""
    left = search.settle(crowding(bands.where("first").drop("first")))
    rest = search.settle(crowding(bands.where("not first").drop("first"), search.labels), lead=False)
    crowded = [x.select("bucket", "node") for x in (left, rest) if x is not None]
    left = reduce(DataFrame.unionByName, crowded) if crowded else None
    # members of crowded buckets by their rarest shingles, then all that is left of crowded postings
    level = 0
    while left is not None:
        level += 1
        left = search.split(left, level)
        left = search.settle(left if level > 1 else crowding(left, search.labels), last=level > 1)


# --- components -------------------------------------------------------------


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): the least node that links lead to, for nodes with links.

    Labels pass to neighbours, then jump to the label of their label, until none
    changes, each round a written table. rounds: stop after so many; labels may
    then be finer than the components, never coarser.
    """
    edges = (
        links.select(F.col("u").alias("x"), F.col("v").alias("y"))
        .unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        .where("x <> y")
        .distinct()
    )
    if rounds is None:
        edges = written(edges, "edges")
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select(
        "node", F.least("node", "y").alias("label")
    )
    turn = 0
    while rounds is None or turn < rounds:
        near = (
            edges.join(labels.select(F.col("node").alias("y"), F.col("label").alias("other")), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        low = written(
            labels.join(near, "node").select("node", "label", F.least("label", "other").alias("low")), "low"
        )
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = low.join(jump, "low").select("node", F.col("label").alias("was"), F.col("lower").alias("label"))
        turn += 1
        if rounds is None:
            new = written(new, "labels")
        labels = new.select("node", "label")
        if rounds is None and new.where("was <> label").isEmpty():
            break
    return labels


def merged(labels: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """labels (node, label) after links (u, v), whose ends labels has: labels are
    joined as components() joins nodes."""
    ends = links.join(labels.select(F.col("node").alias("u"), F.col("label").alias("x")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("y")), "v"
    )
    between = written(
        ends.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "between"
    )
    if between.isEmpty():
        return labels
    lower = components(between, rounds).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    return labels.join(lower, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))


# --- classes ----------------------------------------------------------------


class Texts(NamedTuple):
    """rows: (doc_id, a, b), one row a document; nodes: (node, least, a, b,
    label), one row a text: its least id, and the node that stands for its class."""

    rows: DataFrame
    nodes: DataFrame


def linked(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float,
    idf: float = IDF,
    k: int = K,
    rows: int = ROWS,
    deals: int = DEALS,
) -> Texts:
    """The distinct texts of docs with an id, and their classes."""
    spark: SparkSession = docs.sparkSession
    text = whole(text_col)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit("near"), text).alias("b"),
        text.alias("text"),
    )
    small_batches(spark)
    weights = spark.sparkContext.broadcast(Weights.of(source.select("text"), idf=idf).plain())
    sampled = written(
        source.mapInArrow(
            lean(_sample_texts(weights, k)), "doc_id long, a long, b long, size double, samples array<int>"
        ),
        "samples",
    )
    nodes = written(
        sampled.where("doc_id is not null")
        .groupBy("a", "b")
        .agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("samples").alias("samples"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    buckets = F.array(
        *[
            F.struct(
                F.xxhash64(F.lit(i), *[F.col("samples")[j] for j in band]).alias("bucket"), F.lit(i < k // rows).alias("first")
            )
            for i, band in enumerate(dealt(k, rows, deals))
        ]
    )
    bands = nodes.where("samples is not null").select("node", F.explode(buckets).alias("x"))
    bands = shared(bands.select("node", "x.bucket", "x.first"))
    active = written(nodes.join(bands.select("node").distinct(), "node"), "active")
    search = Search(source, active, weights, threshold, k)
    find_links(bands, search)
    labels = search.labels if search.links is None else merged(search.labels, search.links)
    named = nodes.select("node", "least", "a", "b").join(labels, "node", "left")
    return Texts(
        sampled.select("doc_id", "a", "b"),
        written(named.withColumn("label", F.coalesce("label", "node")), "named"),
    )


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    idf: float = IDF,
    k: int = K,
    rows: int = ROWS,
    deals: int = DEALS,
) -> DataFrame:
    """(doc_id, class_id) of every row: documents whose five-word shingles have
    a weighted Jaccard similarity of threshold or more share a class, and so do
    those that are joined by a chain of such links. class_id is the least id.

    idf: how much rarity counts; 0 is plain (multiset) Jaccard, 1 gives a
    shingle of 1 % of all documents twice the weight of one that all hold.

    Defined cases: exact copies share a class, empty and null texts (read as
    empty) too; a text of under five words is one shingle; a row with a null id
    has a null class and joins none; rows that repeat an id count as versions
    of one document: all their links count, and they share its class; an empty
    table gives no rows; other columns are ignored.
    """
    found = linked(docs, id_col, text_col, threshold, idf, k, rows, deals)
    one = found.rows.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")
    )
    repeated = written(one.where("low <> high").select("doc_id", "low.a", "low.b"), "repeated")
    labelled = found.nodes
    if not repeated.isEmpty():
        names = found.nodes.select("node", "a", "b")
        versions = (
            found.rows.join(repeated.select("doc_id"), "doc_id").distinct().join(names, ["a", "b"])
            .select("doc_id", F.col("node").alias("v"))
            .join(repeated.join(names, ["a", "b"]).select("doc_id", F.col("node").alias("u")), "doc_id")
            .where("u <> v").select("u", "v")
        )
        labels = merged(found.nodes.select("node", "label"), versions)
        labelled = found.nodes.drop("label").join(labels, "node")
    labelled = written(labelled, "labelled")
    names = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    named = written(labelled.join(names, "label").select("a", "b", "class_id"), "classes")
    return found.rows.join(named, ["a", "b"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, idf: float = IDF
) -> DataFrame:
    """docs with one row of each class of near-duplicate texts: the least id's.

    Defined cases: rows with a null id stay; of rows that repeat an id, each
    version is judged by its own text, and of rows that repeat id and text one
    stays; empty texts are copies of each other; an empty table stays empty;
    all columns pass through.
    """
    found = linked(docs, id_col, text_col, threshold, idf)
    best = found.nodes.groupBy("label").agg(F.min(F.struct("least", "a", "b")).alias("best")).select("best.*")
    rows = found.rows.where("doc_id is not null").groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    stays = best.select(F.col("least").alias("doc_id"), "a", "b", F.lit(True).alias("stays"))
    judged = written(
        rows.join(stays, ["doc_id", "a", "b"], "left").where("stays is null or n > 1"), "judged"
    )
    i, a, b = (fresh(docs, c) for c in "iab")
    named = [F.col("doc_id").alias(i), F.col("a").alias(a), F.col("b").alias(b)]
    text = whole(text_col)
    same = (
        (F.col(id_col).cast("long") == F.col(i))
        & (F.xxhash64(text).bitwiseXOR(F.col(a)) == 0)
        & (F.xxhash64(F.lit("near"), text).bitwiseXOR(F.col(b)) == 0)
    )
    kept = docs.join(Search._small(judged.select(*named)), same, "left_anti")
    again = judged.where("stays")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again.select(*named), same, "left_semi").dropDuplicates([id_col, text_col]))
