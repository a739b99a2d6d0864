"""Best-fit packing of token pieces into sequences by swap-based local search.

What a packing may do depends on the lengths alone, and there are at most
``max_tokens`` of them. So the search runs on bin patterns with multiplicities
(three thousand bins that each hold lengths 700 and 324 are one entry): its
cost depends on the number of lengths, not of documents, and it sees the whole
corpus at once. Spark does the rest: tokenizing, counting lengths, giving each
piece its rank among the pieces of its length, and placing it.

Search: best-fit decreasing gives a start. Then moves between underfull bins
that raise the sum of squared fills: move a piece into a fuller bin, exchange
one for one, two for one, or one for two. Emptied bins vanish. It ends at the lower bound
ceil(tokens / max_tokens), or when no move is left for any bin; nothing else
stops it.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import lean, small_batches, whole, written
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- the search, on lengths and counts --------------------------------------


def twos(pattern: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Two lengths of a pattern by their sum."""
    ones = sorted(set(pattern), reverse=True)
    return {x + y: (x, y) for i, x in enumerate(ones) for y in ones[i:] if x != y or pattern.count(x) > 1}


class Bins:
    """Groups of equal bins: pattern (lengths, descending) -> number of bins.

    Underfull groups are indexed by free room and by the lengths that they hold;
    each holds length 0 too, so that a move is an exchange with nothing. A second
    index has the sums of two of their lengths.
    """

    def __init__(self, room: int):
        self.room = room
        self.groups: dict[tuple[int, ...], int] = {}
        self.having: dict[tuple[int, int], dict[tuple[int, ...], None]] = {}
        self.n_having = np.zeros((room + 1, room + 1), np.int32)
        self.pairs: dict[tuple[int, int], dict[tuple[int, ...], tuple[int, int]]] = {}
        self.n_pairs = np.zeros((room + 1, room + 1), np.int32)
        self.n_bins = 0

    def put(self, pattern: tuple[int, ...], n: int) -> None:
        if not pattern or not n:
            return
        self.n_bins += n
        if pattern not in self.groups:
            free = self.room - sum(pattern)
            for x in {0, *pattern} if free else ():
                self.having.setdefault((x, free), {})[pattern] = None
                self.n_having[x, free] += 1
            for x, two in twos(pattern).items() if free else ():
                self.pairs.setdefault((x, free), {})[pattern] = two
                self.n_pairs[x, free] += 1
        self.groups[pattern] = self.groups.get(pattern, 0) + n

    def take(self, pattern: tuple[int, ...], n: int) -> None:
        self.n_bins -= n
        self.groups[pattern] -= n
        if not self.groups[pattern]:
            del self.groups[pattern]
            free = self.room - sum(pattern)
            for x in {0, *pattern} if free else ():
                del self.having[x, free][pattern]
                self.n_having[x, free] -= 1
            for x in twos(pattern) if free else ():
                del self.pairs[x, free][pattern]
                self.n_pairs[x, free] -= 1

    def count(self) -> int:
        return self.n_bins


def best_fit(counts: dict[int, int], room: int) -> Bins:
    """Best-fit decreasing over a histogram of lengths."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(room + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        free = length
        while left and free <= room:
            if not open_[free]:
                free += 1
                continue
            pattern, n = open_[free].pop()
            used = min(n, left)
            if used < n:
                open_[free].append((pattern, n - used))
            left -= used
            open_[free - length].append((pattern + (length,), used))
            free = max(length, free - length)
        each = room // length
        if left >= each:
            open_[room - each * length].append(((length,) * each, left // each))
        if left % each:
            open_[room - left % each * length].append(((length,) * (left % each), 1))
    bins = Bins(room)
    for groups in open_:
        for pattern, n in groups:
            bins.put(pattern, n)
    return bins


def _swap(bins: Bins, b: tuple[int, ...]):
    """The change that raises the sum of squared fills most, between a bin of
    pattern b and one as full or fuller: (a, pieces a gives, pieces it gets).

    A move, an exchange one for one, two of b for one of a, or one for two; None
    if none is left.
    """
    free_b = bins.room - sum(b)
    frees = np.flatnonzero(bins.n_having[0, : free_b + 1])
    if not len(frees):
        return None
    ones = {x: (x,) for x in set(b)}
    # a gains d and b loses it: the squares grow by 2 d (fill a - fill b + d)
    found = []
    for two, held, gets in ((False, bins.n_having, twos(b) | ones), (True, bins.n_pairs, ones)):
        for total, pieces in gets.items():
            least = max(0, total - free_b)
            ys = np.arange(least, min(total, bins.room + 1))
            d = (total - ys)[:, None]
            gain = np.where(
                (held[least : least + len(ys), frees] > 0) & (frees[None, :] >= d), d * (free_b - frees + d), 0
            )
            if gain.any():
                found.append((int(gain.max()), total, two, pieces, ys, gain))
    for _, _, two, pieces, ys, gain in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        for at in np.argsort(-gain, axis=None, kind="stable")[: np.count_nonzero(gain)]:
            i, j = divmod(int(at), gain.shape[1])
            y = int(ys[i])
            for a in (bins.pairs if two else bins.having)[y, int(frees[j])]:
                if a != b or bins.groups[a] > 1:
                    return a, bins.pairs[y, int(frees[j])][a] if two else (y,) if y else (), pieces
    return None


def _changed(pattern: tuple[int, ...], out, in_) -> tuple[int, ...]:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted(left + list(in_), reverse=True))


def local_search(bins: Bins) -> Bins:
    """Empties bins by changes that raise the sum of squared fills, the emptiest
    bins first, until the lower bound is reached or no change is left.

    A change is made for as many bins of the two patterns as there are.
    """
    room = bins.room
    bound = math.ceil(sum(sum(p) * n for p, n in bins.groups.items()) / room)
    moved = True
    while moved and bins.count() > bound:
        moved = False
        waiting = [(sum(p), p) for p in bins.groups if sum(p) < room]
        heapq.heapify(waiting)
        while waiting and bins.count() > bound:
            donor = heapq.heappop(waiting)[1]
            found = _swap(bins, donor) if donor in bins.groups else None
            if not found:
                continue
            fuller, gives, gets = found
            same = fuller == donor
            n = bins.groups[donor] // 2 if same else min(bins.groups[donor], bins.groups[fuller])
            bins.take(fuller, n)
            bins.take(donor, n)
            for p in (_changed(fuller, gives, gets), _changed(donor, gets, gives), donor):
                if p is not donor:
                    bins.put(p, n)
                if p in bins.groups and sum(p) < room:
                    heapq.heappush(waiting, (sum(p), p))
            moved = True
    return bins


def plan(counts: dict[int, int], room: int) -> Bins:
    return local_search(best_fit(counts, room))


def slots(bins: Bins) -> pd.DataFrame:
    """(length, first, n, sequence, offset): pieces of a length with ranks
    first .. first + n - 1 go to sequences sequence, sequence + 1, ... at offset."""
    rows, used, sequence = [], {}, 0
    for pattern, n in sorted(bins.groups.items()):
        at = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), n, sequence, at))
            used[length] = used.get(length, 0) + n
            at += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "offset"])


# --- Spark ------------------------------------------------------------------


def _cut(path: str, end_id: int, room: int):
    def run(batches):
        encoder, end = Encoder.of(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.batch(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at, to, piece = 0, (n - 1) % room + 1, 0
                while at < n:
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, piece = to, to + room, piece + 1
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32). A document longer than
    max_tokens is cut so that its first piece is the shorter one."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")
    ).mapInArrow(lean(_cut(tokenizer, end_id, max_tokens), encodes=True), PIECES)


def _place(sent):
    def run(frames):
        table = sent.value
        keys = (table.length.to_numpy(np.int64) << 44) + table["first"].to_numpy(np.int64)
        first, sequence, offset = (
            table[c].to_numpy(np.int64) for c in ("first", "sequence", "offset")
        )
        for f in frames:
            rank = f.pop("rank").to_numpy(np.int64)
            i = np.searchsorted(keys, (f.length.to_numpy(np.int64) << 44) + rank, "right") - 1
            yield f.assign(sequence_id=sequence[i] + rank - first[i], offset=offset[i])

    return run


def ranked(table: DataFrame) -> DataFrame:
    """table with rank: each row's place among those of its length, from 0.

    Without one window for each length, which would put a frequent length in
    one task: rows fall into about sqrt(n) blocks, are numbered within (block,
    length), and a running sum over the blocks' counts gives each its base.
    """
    blocks = max(1, math.isqrt(table.count()))
    # the hash of the piece's own values: equal for equal rows in every retry
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    table = table.withColumn("block", block)
    base = (
        table.groupBy("length", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "base",
            F.sum("n").over(
                Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("length", "block", F.coalesce("base", F.lit(0)).alias("base"))
    )
    place = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        table.withColumn("place", F.row_number().over(place))
        .join(base, ["length", "block"])
        .withColumn("rank", F.col("base") + F.col("place") - 1)
        .drop("block", "base", "place")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Placement of every piece: pieces() with sequence_id and offset.

    Sequences are gapless from offset 0 and hold at most max_tokens tokens.
    Defined cases: a null or empty text is a piece of the end id alone; rows
    that repeat an id are packed each; an empty table gives no rows; other
    columns of docs are ignored.
    """
    table = written(pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    where = slots(plan(counts, max_tokens)).sort_values(["length", "first"])
    sent = docs.sparkSession.sparkContext.broadcast(where)
    return ranked(table).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank"
    ).mapInPandas(_place(sent), PIECES + ", sequence_id long, offset long")
