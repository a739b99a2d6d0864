"""Match data kept in step with the jobs: token columns, statistics, bounds.

The index has a row for each job: its id, the token array of each text column,
the number of tokens, and a block of neighbouring ids. Statistics are sums over
it: rows and tokens in all, and the jobs that hold each term. A batch changes
both by what the jobs it touches held before and hold now, so neither is counted
anew, and closing a job or marking it changes nothing. Queries read the index and
a few rows of the statistics, never the texts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import COLUMNS, equals, with_tokens
from ..sources.scratch import written

#: Ids in a block, and BM25's two constants.
BLOCK, K1, B = 4096, 1.2, 0.75
TOKENS = [f"{c}_tokens" for c in COLUMNS]
#: The term of the statistics' row for the whole index; no token is empty.
ALL = ""
#: Ids of a batch that are sent to all tasks; beyond it the index is dealt to them.
SENT = 500_000


def entries(jobs: DataFrame) -> DataFrame:
    """The index rows of jobs (id and the text columns)."""
    rows = with_tokens(jobs.select("id", *COLUMNS)).select("id", *TOKENS)
    n = reduce(lambda a, b: a + b, [F.size(t) for t in TOKENS])
    return rows.withColumns({"n": n.cast("bigint"), "block": F.floor(F.col("id") / BLOCK)})


def _counts(index: DataFrame, sign: int) -> DataFrame:
    """(term, docs, total), each counted sign times."""
    terms = index.select(F.explode(F.array_distinct(F.flatten(F.array(*TOKENS)))).alias("term"))
    held = terms.select("term", F.lit(sign).cast("bigint").alias("docs"), F.lit(0).cast("bigint").alias("total"))
    whole = index.select(F.lit(ALL).alias("term"), F.lit(sign).cast("bigint").alias("docs"), (F.col("n") * sign).alias("total"))
    return held.unionByName(whole)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))


def statistics(index: DataFrame) -> DataFrame:
    """(term, docs, total) of a whole index; total is that of all tokens and
    stands in the row of ALL."""
    return _summed(_counts(index, 1))


class Change(NamedTuple):
    index: DataFrame
    delta: DataFrame


def changed(index: DataFrame, jobs: DataFrame, gone: DataFrame | None = None) -> Change:
    """The index after jobs (rows as they are now, new or changed; one row an id)
    and gone (id) went in, and what that adds to the statistics. Rows of jobs whose
    texts did not change add nothing.

    Both are written: the index is joined to the batch's ids once, and texts are
    made tokens once. The ids are hashed, so no task sorts rows of the index.
    """
    now = jobs if gone is None else jobs.join(gone.select("id"), "id", "left_anti")
    new = written(entries(now), "entries")
    ids = new.select("id") if gone is None else new.select("id").unionByName(gone.select("id"))
    ids = ids.distinct().withColumn("_hit", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("shuffle_hash")
    marked = written(index.join(ids, "id", "left"), "index")
    old, kept = marked.where("_hit").drop("_hit"), marked.where("_hit is null").drop("_hit")
    delta = _summed(_counts(old, -1).unionByName(_counts(new, 1))).where("docs <> 0 or total <> 0")
    return Change(kept.unionByName(new), delta)


def added(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """stats with a delta; terms that no job holds any more go."""
    return _summed(stats.unionByName(delta)).where(f"docs <> 0 or term = '{ALL}'")


# --- relevance --------------------------------------------------------------


class Corpus(NamedTuple):
    """What BM25 needs to know of all rows: a few numbers, read by term."""

    rows: int
    mean: float
    docs: tuple[int, ...]


def corpus(stats: DataFrame, words: list[str]) -> Corpus:
    """The statistics for some words; one row for each is read."""
    found = {r["term"]: r for r in stats.where(F.col("term").isin(ALL, *words)).collect()}
    whole = found.get(ALL)
    n, total = (whole["docs"], whole["total"]) if whole else (0, 0)
    return Corpus(n, total / n if n else 0.0, tuple(found[w]["docs"] if w in found else 0 for w in words))


def _score(tf: list[Column], length: Column, of: Corpus) -> Column:
    out = F.lit(0.0)
    for x, docs in zip(tf, of.docs):
        idf = F.log(F.lit(1 + (of.rows - docs + 0.5) / (docs + 0.5)))
        out = out + idf * x * (K1 + 1) / (x + K1 * (1 - B + B * length / F.lit(of.mean or 1.0)))
    return out


def _times(words: list[str]) -> list[Column]:
    all_ = F.flatten(F.array(*TOKENS))
    return [F.size(F.filter(all_, equals(w))) for w in words]


def ranked(rows: DataFrame, of: Corpus, words: list[str]) -> DataFrame:
    """rows (with token columns) and rank, lower is better: BM25 over all columns
    together, by the statistics of the whole index, without a pass over it."""
    length = reduce(lambda a, b: a + b, [F.size(t) for t in TOKENS])
    return rows.withColumn("rank", -_score(_times(words), length, of))


def bounds(index: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(block, term, most, shortest): how often a row of a block holds a term at
    most, and the fewest tokens of its rows that do; of some words, or of all.
    Some words are counted in each row where it lies."""
    if words is None:
        flat = index.select("block", "id", "n", F.explode(F.flatten(F.array(*TOKENS))).alias("term"))
        by_row = flat.groupBy("block", "id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        each = F.array(*[F.struct(F.lit(w).alias("term"), x.cast("bigint").alias("tf")) for w, x in zip(words, _times(words))])
        by_row = index.select("block", "n", F.inline(each)).where("tf > 0")
    return by_row.groupBy("block", "term").agg(F.max("tf").alias("most"), F.min("n").alias("shortest"))


def best(index: DataFrame, bounds: DataFrame, of: Corpus, words: list[str], k: int, seeds: int = 4) -> DataFrame:
    """(id, rank): the k rows that rank best, those without any word left out.

    A block ranks no better than a row that held each word as often as any of its
    rows, in the shortest of them. The blocks of the best bounds are ranked first;
    then only those are read whose bound reaches the k-th of the rows found there.
    """
    if len(set(words)) < len(words):
        raise ValueError("words must differ")
    own = bounds.where(F.col("term").isin(words))
    place = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("term"))
    part = F.lit(0.0)
    for i, docs in enumerate(of.docs):
        alone = _score([F.col("most")], F.col("shortest"), of._replace(docs=(docs,)))
        part = F.when(place == i + 1, alone).otherwise(part)
    # doubles are summed in another order than in a rank: the bound is widened
    blocks = written(own.groupBy("block").agg((F.sum(part) * (1 + 1e-9)).alias("bound")), "blocks")
    first = [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(seeds).collect()]
    rows = ranked(index.where(F.exists(F.flatten(F.array(*TOKENS)), lambda x: x.isin(words))), of, words)
    top = rows.where(F.col("block").isin(first)).select("rank").orderBy("rank").limit(k).collect()
    need = -top[-1]["rank"] if len(top) == k else 0.0
    wanted = blocks.where(F.col("bound") >= need).select("block")
    return rows.join(wanted, "block", "left_semi").select("id", "rank").orderBy("rank", "id").limit(k)
