"""Line dedup: exact reference counts with sharded cuckoo filters before them.

State of a corpus:

* ``lines``: (h, g, doc_id, n), how many rows of a document hold a line key;
  (h, g) are 128 hash bits of the key. Documents are counted in and out here.
* ``refs``: (h, g, n_docs, keeper), the exact reference counts: how many
  documents hold a key, and the largest id among them.

  Both are kept in runs. A batch writes a run of its own lines, signed, and one
  of the new counts of its keys; earlier runs are read for these keys, and never
  moved or written again until RUNS of them are merged.
* ``filters``: one cuckoo filter for each shard of keys, holding those whose
  reference count has reached ``min_docs``. Unlike a Bloom filter it supports
  deletion, so when documents leave, keys that fall below the threshold leave
  the filter, and lines come back.

``insert`` and ``delete`` take a batch of documents and change the counts of its
keys and the filters of their shards; a shard that fills up is built anew, and
all are dealt to more shards when they hold too many keys. ``dedup`` cuts any
documents, the corpus or a batch of it, by the state: each line goes past the
filters, and what they let through meets ``refs``, which decide. A filter thus
saves work but never decides.

Skew: counts are combined before the shuffle; a key in a third of all documents
is spread by (key, doc_id) for its exact count, and the join that marks its
lines is an equi join of two tables, which adaptive execution splits.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, lean, small_batches, whole, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4
SHARD_KEYS = 50_000
#: Largest filters that are sent to every task; beyond it, lines are dealt to the
#: filters' shards, in groups of about GROUP_LINES.
FILTER_BYTES = 32 << 20
GROUP_LINES = 200_000
#: Runs of a state before they are merged, and keys of a batch that are sent to
#: all tasks to find their rows in the runs (beyond it, runs are shuffled).
RUNS, SENT_KEYS = 8, 1_000_000
#: A filter fuller than this is built anew, with room for twice its keys.
FULL = 0.8

FILTER_SCHEMA = "shard long, n_buckets long, held long, slots binary, stash binary"
HIT = "doc_id long, th long, pos int, h long, g long"


class LineState(NamedTuple):
    line_runs: tuple[DataFrame, ...]
    ref_runs: tuple[DataFrame, ...]
    """In order of their age; the newest that has a key counts."""
    filters: DataFrame
    n_shards: int
    n_repeated: int = 0
    """Keys that the filters hold."""

    @property
    def lines(self) -> DataFrame:
        return _held(self.line_runs)

    @property
    def refs(self) -> DataFrame:
        return _latest(self.ref_runs)


def _held(runs: tuple[DataFrame, ...]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy("h", "g", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")


def _latest(runs: tuple[DataFrame, ...]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    rows = reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
    last = F.max_by(F.struct("n_docs", "keeper"), "run").alias("last")
    return rows.groupBy("h", "g").agg(last).select("h", "g", "last.*").where("n_docs > 0")


def _of(runs: tuple[DataFrame, ...], keys: DataFrame, n_keys: int) -> tuple[DataFrame, ...]:
    """The rows of some keys (h, g), without moving the runs if these are few."""
    keys = F.broadcast(keys) if n_keys <= SENT_KEYS else keys
    return tuple(r.join(keys, ["h", "g"], "left_semi") for r in runs)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def folded(cut: Column) -> Column:
    """A trimmed line with A-Z in lower case: its key."""
    # lower() equals the ASCII fold on ASCII lines and is far faster there
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(
        F.translate(cut, UPPER, LOWER)
    )


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, th, keys): keys of long enough lines with their position."""
    # each step is a transform of its own, so that nothing is worked out twice
    keys = F.transform(
        F.split(whole(text_col), "\n", -1),
        lambda x, i: F.struct(i.cast("int").alias("pos"), trimmed(x).alias("key")),
    )
    keys = F.filter(keys, lambda s: F.char_length(s["key"]) >= min_chars)
    keys = F.transform(keys, lambda s: F.struct(s["pos"].alias("pos"), folded(s["key"]).alias("key")))
    keys = F.transform(
        keys,
        lambda s: F.struct(
            s["pos"].alias("pos"),
            F.xxhash64(s["key"]).alias("h"),
            F.xxhash64(F.lit("line"), s["key"]).alias("g"),
        ),
    )
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(whole(text_col)).alias("th"),
        keys.alias("keys"),
    )


def held_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20
) -> DataFrame:
    """(h, g, doc_id, n): n rows of the document hold the key; null ids are left out."""
    once = F.array_distinct(
        F.transform(F.col("keys"), lambda s: F.struct(s["h"].alias("h"), s["g"].alias("g")))
    )
    return (
        _lines(docs, id_col, text_col, min_chars)
        .where("doc_id is not null")
        .select("doc_id", F.explode(once).alias("k"))
        .groupBy(F.col("k.h").alias("h"), F.col("k.g").alias("g"), "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")
    )


# --- cuckoo filters ---------------------------------------------------------


def _fingerprints(h: np.ndarray) -> np.ndarray:
    fp = (h.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
    fp[fp == 0] = 1
    return fp


def _jump(fp: np.ndarray, mask) -> np.ndarray:
    """What turns one bucket of a fingerprint into the other."""
    return ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.asarray(
        mask, np.uint64
    )


class Cuckoo:
    """A filter of 64-bit hashes: buckets of four 16-bit fingerprints, and a
    stash of whole hashes for the few that find no room."""

    def __init__(self, n_buckets: int, slots: bytes | None = None, stash: bytes = b""):
        self.n = n_buckets
        self.slots = (
            np.zeros((n_buckets, SLOTS), np.uint16)
            if slots is None
            else np.frombuffer(slots, np.uint16).reshape(n_buckets, SLOTS).copy()
        )
        self.stash = set(np.frombuffer(stash, np.int64).tolist())

    @classmethod
    def of(cls, keys: np.ndarray) -> "Cuckoo":
        """A filter of distinct keys, at most half full, all placed together."""
        f = cls(1 << max(2, math.ceil(math.log2(max(1, len(keys)) / (0.5 * SLOTS)))))
        fp = _fingerprints(keys)
        owner = np.full((f.n, SLOTS), -1)
        at = (keys.view(np.uint64) & np.uint64(f.n - 1)).astype(np.int64)
        left = np.arange(len(keys))
        for turn in range(500):
            if not len(left):
                break
            left = left[np.argsort(at[left], kind="stable")]
            bucket = at[left]
            rank = np.arange(len(left)) - np.searchsorted(bucket, bucket)
            free = np.argsort(owner[bucket] >= 0, axis=1, kind="stable")
            room = (owner[bucket] < 0).sum(axis=1)
            fits = rank < room
            owner[bucket[fits], free[np.flatnonzero(fits), rank[fits]]] = left[fits]
            # of those left over in a bucket, one puts out a key, which goes to its other bucket
            over = ~fits & (rank == room)
            slot = (left[over] + turn) % SLOTS
            out = owner[bucket[over], slot]
            owner[bucket[over], slot] = left[over]
            rest = left[~fits & (rank > room)]
            both = np.concatenate([out, rest])
            at[both] ^= _jump(fp[both], f.n - 1).astype(np.int64)
            left = both
        f.stash = set(keys[left].tolist())
        placed = owner >= 0
        f.slots[placed] = fp[owner[placed]]
        return f

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.slots)) + len(self.stash)

    def _places(self, h: int) -> tuple[int, int, int]:
        one = np.array([h], np.int64)
        fp = _fingerprints(one)
        i = int(one.view(np.uint64)[0] & np.uint64(self.n - 1))
        return int(fp[0]), i, i ^ int(_jump(fp, self.n - 1)[0])

    def add(self, h: int) -> None:
        fp, i, j = self._places(h)
        for b in (i, j):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = fp
                return
        b, held, path = j, fp, []
        for turn in range(200):
            s = (held + turn) % SLOTS
            path.append((b, s))
            held, self.slots[b, s] = int(self.slots[b, s]), held
            b ^= int(_jump(np.array([held], np.uint16), self.n - 1)[0])
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = held
                return
        for b, s in reversed(path):  # no room: put all back, keep the hash itself
            held, self.slots[b, s] = int(self.slots[b, s]), held
        self.stash.add(h)

    def remove(self, h: int) -> None:
        """h must have been added."""
        if h in self.stash:
            self.stash.remove(h)
            return
        fp, i, j = self._places(h)
        for b in (i, j):
            at = np.flatnonzero(self.slots[b] == fp)
            if len(at):
                self.slots[b, at[0]] = 0
                return

    def row(self, shard: int) -> dict:
        stash = np.array(sorted(self.stash), np.int64).tobytes()
        return {
            "shard": shard, "n_buckets": self.n, "held": self.held, "slots": self.slots.tobytes(), "stash": stash
        }


def _change_filter(key, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter with keys added (sign 1) or removed (-1)."""
    f = Cuckoo(int(old.n_buckets[0]), old.slots[0], old.stash[0])
    for h in change.h[change.sign < 0]:
        f.remove(int(h))
    for h in change.h[change.sign > 0]:
        f.add(int(h))
    return pd.DataFrame([f.row(int(key[0]))])


def _build_filter(key, keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([Cuckoo.of(np.unique(keys.h.to_numpy(np.int64))).row(int(key[0]))])


def _shard(n_shards: int) -> Column:
    return F.pmod(F.col("g"), F.lit(n_shards)).cast("long").alias("shard")


def _built(keys: DataFrame, n_shards: int) -> DataFrame:
    """Filters of keys (h, g). A shard has about SHARD_KEYS keys, so no group
    grows with the corpus."""
    return keys.select(_shard(n_shards), "h").groupBy("shard").applyInPandas(_build_filter, FILTER_SCHEMA)


def empty_state(docs: DataFrame, n_shards: int = 1) -> LineState:
    spark = docs.sparkSession
    return LineState(
        (spark.createDataFrame([], "h long, g long, doc_id long, n long"),),
        (spark.createDataFrame([], "h long, g long, n_docs long, keeper long"),),
        spark.createDataFrame([], FILTER_SCHEMA),
        n_shards,
    )


def _changed(state: LineState, keys: DataFrame, change: DataFrame) -> DataFrame:
    """Filters after change (h, g, sign); keys (h, g) is all that they then hold.
    Shards that would be too full, or whose keys change by half or more, are
    built anew; those without a change stay."""
    rows = written(change.select(_shard(state.n_shards), "h", "sign"), "filter-change")
    room = F.col("n_buckets") * SLOTS
    loads = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("sign").alias("more")).join(
        state.filters.select("shard", "n_buckets", "held"), "shard", "left"
    )
    anew = F.col("held").isNull() | (F.col("held") + F.col("more") > FULL * room) | (2 * F.col("n") > F.col("held"))
    loads = written(loads.select("shard", anew.alias("anew")), "filter-loads")
    same = state.filters.join(loads, "shard", "left_anti")
    little = loads.where("not anew").select("shard")
    edited = (
        state.filters.join(little, "shard").groupBy("shard")
        .cogroup(rows.join(little, "shard").groupBy("shard"))
        .applyInPandas(_change_filter, FILTER_SCHEMA)
    )
    out = same.unionByName(edited)
    if loads.where("anew").isEmpty():
        return out
    built = _built(
        keys.withColumn("shard", _shard(state.n_shards)).join(loads.where("anew").select("shard"), "shard"),
        state.n_shards,
    )
    return out.unionByName(built)


def _merge(state: LineState, batch: DataFrame, sign: int, min_docs: int) -> LineState:
    first = len(state.line_runs) == 1 and state.line_runs[0].isEmpty()
    if first:
        lines = written(batch, "lines")
        line_runs, ref_runs = (lines,), (written(_counted(lines), "line-refs"),)
        repeated = ref_runs[0].where(F.col("n_docs") >= min_docs).select("h", "g")
        n_repeated, change = repeated.count(), None
    else:
        batch = written(batch.withColumn("n", F.col("n") * sign), "line-batch")
        touched = written(batch.select("h", "g").distinct(), "line-touched")
        n_touched = touched.count()
        line_runs = (*state.line_runs, batch)
        now = _counted(_held(_of(line_runs, touched, n_touched)))
        now = touched.join(now, ["h", "g"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        now = written(now, "line-refs")
        ref_runs = (*state.ref_runs, now)
        was = _latest(_of(state.ref_runs, touched, n_touched)).where(F.col("n_docs") >= min_docs)
        was = was.select("h", "g", F.lit(1).alias("was"))
        step = (F.col("n_docs") >= min_docs).cast("int") - F.coalesce("was", F.lit(0))
        change = written(now.join(was, ["h", "g"], "left").select("h", "g", step.alias("sign")).where("sign <> 0"), "line-change")
        n_repeated = state.n_repeated + (change.agg(F.sum("sign")).first()[0] or 0)
        repeated = _latest(ref_runs).where(F.col("n_docs") >= min_docs).select("h", "g")
    if len(line_runs) > RUNS:
        line_runs = (written(_held(line_runs), "lines"),)
        ref_runs = (written(_latest(ref_runs), "line-refs"),)
    n_shards = max(state.n_shards, math.ceil(n_repeated / SHARD_KEYS))
    if n_shards > state.n_shards:  # twice as many at least, so that this is rare
        n_shards = max(n_shards, 1 if first else 2 * state.n_shards)
    filters = _built(repeated, n_shards) if first or n_shards > state.n_shards else _changed(state, repeated, change)
    return LineState(line_runs, ref_runs, written(filters, "line-filters"), n_shards, n_repeated)


def insert(
    state: LineState,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> LineState:
    """state with docs counted in.

    Defined cases, here and in delete: rows with a null id count nothing; rows
    that repeat an id count as one document with the lines of all, also over
    several batches; null and empty texts have no key; an empty batch changes no
    count; texts and lines of any length are read whole; other columns are ignored.
    """
    return _merge(state, held_lines(docs, id_col, text_col, min_chars), 1, min_docs)


def delete(
    state: LineState,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> LineState:
    """state with docs, which must have been inserted, counted out again. Counts
    and keepers are then those of the documents that are left."""
    return _merge(state, held_lines(docs, id_col, text_col, min_chars), -1, min_docs)


class Filters:
    """Shards as flat arrays, probed without Python loops."""

    def __init__(self, n_shards: int, start: np.ndarray, n: np.ndarray, slots: np.ndarray, stash: np.ndarray):
        self.n_shards, self.start, self.n, self.slots, self.stash = n_shards, start, n, slots, stash

    def plain(self) -> tuple:
        """What Filters(*plain) makes again: workers get no class of this package."""
        return self.n_shards, self.start, self.n, self.slots, self.stash

    @classmethod
    def of(cls, rows: list, n_shards: int) -> "Filters":
        start, n = np.zeros(n_shards, np.int64), np.zeros(n_shards, np.int64)
        parts, at, stash = [np.zeros((1, SLOTS), np.uint16)], 1, [np.zeros(0, np.int64)]
        for r in rows:
            start[r["shard"]], n[r["shard"]] = at, r["n_buckets"]
            parts.append(np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS))
            at += r["n_buckets"]
            stash.append(np.frombuffer(r["stash"], np.int64))
        return cls(n_shards, start, n, np.concatenate(parts), np.unique(np.concatenate(stash)))

    def hold(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        shard = np.mod(g, self.n_shards)
        n, start, fp = self.n[shard], self.start[shard], _fingerprints(h)
        mask = np.maximum(n - 1, 0).astype(np.uint64)
        i = h.view(np.uint64) & mask
        j = i ^ _jump(fp, mask)
        found = np.zeros(len(h), bool)
        for b in (i, j):
            found |= (self.slots[start + b.astype(np.int64)] == fp[:, None]).any(axis=1)
        return (found & (n > 0)) | np.isin(h, self.stash)


def _probe(sent):
    def run(batches):
        filters = Filters(*sent.value)
        for b in batches:
            keys = b.column(2)
            n = np.asarray(keys.value_lengths().fill_null(0))
            flat = keys.flatten()
            h, g = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "g"))
            keep = np.flatnonzero(filters.hold(h, g)) if len(h) else np.zeros(0, np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n)[keep])
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row)]
                + [flat.field(c).take(at) for c in ("pos", "h", "g")],
                names=["doc_id", "th", "pos", "h", "g"],
            )

    return run


def _probe_shard(key, filters: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    columns = ["doc_id", "th", "pos", "h", "g"]
    if not len(filters) or not len(lines):
        return lines.iloc[:0][columns] if len(lines) else pd.DataFrame(columns=columns)
    one = Filters.of([{**filters.iloc[0], "shard": 0}], 1)
    return lines[columns][one.hold(lines.h.to_numpy(np.int64), np.zeros(len(lines), np.int64))]


def _probed_by_shard(lines: DataFrame, state: LineState) -> DataFrame:
    """Lines that the filters let through, for filters that are too large to
    send: lines are dealt to the filters' shards, and a shard with many lines
    (a frequent line may have a third of all) to several groups, each of which
    gets the shard's filter."""
    rows = lines.select("doc_id", "th", F.inline("keys")).withColumn("shard", _shard(state.n_shards))
    groups = written(
        rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINES).cast("int").alias("groups")), "shard-groups"
    )
    part = F.pmod(F.xxhash64("doc_id", "th", "pos"), F.col("groups")).cast("int")
    filters = state.filters.join(groups, "shard").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    )
    return (
        filters.drop("groups").groupBy("shard", "part")
        .cogroup(rows.join(groups, "shard").withColumn("part", part).drop("groups").groupBy("shard", "part"))
        .applyInPandas(_probe_shard, HIT)
    )


def repeated_lines(
    docs: DataFrame,
    state: LineState,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """(doc_id, th, pos) of the lines that dedup drops."""
    spark = docs.sparkSession
    lines = _lines(docs, id_col, text_col, min_chars)
    size = state.filters.select(
        F.sum(F.octet_length("slots") + F.octet_length("stash") + 64)
    ).first()[0]
    if (size or 0) <= FILTER_BYTES:
        sent = spark.sparkContext.broadcast(Filters.of(state.filters.collect(), state.n_shards).plain())
        maybe = lines.mapInArrow(lean(_probe(sent)), HIT)
    else:
        maybe = _probed_by_shard(lines, state)
    # tables on both sides, so that the join can be split where a key is frequent
    maybe = written(maybe, "line-maybe")
    runs = state.ref_runs
    if len(runs) > 1:
        keys = written(maybe.select("h", "g").distinct(), "line-keys")
        runs = _of(runs, keys, keys.count())
    held = written(_latest(runs).where(F.col("n_docs") >= min_docs).select("h", "g", "keeper"), "line-held")
    return (
        maybe
        .join(held, ["h", "g"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("doc_id", "th", "pos")
    )


def _without(text: Column, drop: Column) -> Column:
    """A text without the lines at some places; drop may be null."""
    lines = F.split(text, "\n", -1)

    def rest(ls: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop)
        return F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n")

    return F.when(drop.isNull(), text).otherwise(F.get(F.transform(F.array(lines), rest), 0))


def dedup(
    docs: DataFrame,
    state: LineState | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """docs with ``text_col`` cut to its kept lines, and n_lines, n_dropped.

    A key of at least min_chars code points found in at least min_docs
    documents (distinct non-null ids) of the state's corpus loses all its lines
    except those in the largest id that holds it. Without a state, docs are the
    corpus. Defined cases: a null text counts as one empty line and becomes '';
    rows that repeat an id count as one document and are each cut; rows with a
    null id lose such lines but never count or keep; an empty table gives an
    empty result; texts and lines of any length are cut whole. Other columns
    pass through (columns called n_lines or n_dropped are replaced).
    """
    small_batches(docs.sparkSession)
    if state is None:
        state = insert(empty_state(docs), docs, id_col, text_col, min_chars, min_docs)
    i, th, drop = (fresh(docs, c) for c in ("gone_id", "gone_th", "gone"))
    drops = (
        repeated_lines(docs, state, id_col, text_col, min_chars, min_docs)
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias(drop))
        .select(F.col("doc_id").alias(i), F.col("th").alias(th), drop)
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole_docs = docs.select(*rest).withColumn(text_col, whole(text_col))
    return (
        whole_docs.join(
            drops,
            F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(th)),
            "left",
        )
        .select(
            *[c for c in rest if c != text_col],
            F.size(F.split(F.col(text_col), "\n", -1)).cast("long").alias("n_lines"),
            F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
            _without(F.col(text_col), F.col(drop)).alias(text_col),
        )
        .select(*rest, "n_lines", "n_dropped")
    )
