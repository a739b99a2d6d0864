"""Benchmark decontamination: MinHash containment search, partitioned by size.

Which test items are contained in which documents? Items are short and
documents long, so the Jaccard similarity of the two is tiny, and sketches of
whole documents would miss items. The containment of an item can be read off a
sketch of the item alone: its m least hashes (bottom-m MinHash), looked up in
the documents. Both sides are partitioned by size:

* Items by words: those of five or more have five-word shingles; shorter ones
  are one shingle of all their words, which is looked up among the document
  shingles of that width only.
* Items by shingles: one of q shingles has m = floor((1 - threshold) q) + 1, the
  fewest with which every document that holds threshold * q of its shingles
  holds one of the sketch for certain. So larger items get longer sketches, and
  the search loses nothing.
* Documents: those with fewer shingles than threshold * q do not meet the item.

Hashes that many items share come last in a sketch, so that a phrase common to
many items brings few candidates. Candidates are verified by exact containment
of word shingles, as text.

All of it is DataFrame operations. Documents are read twice and only those
with a candidate are moved; the sketches are broadcast when they are small and
met by a shuffle join otherwise, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, whole, written

WORDS = 5
#: Characters between words, in lower-cased text: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Sketch rows (24 bytes each) up to which they are sent to every task.
SENT = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def shingles(ws: Column, of: int, make) -> Column:
    """make(place) for each place of a run of ``of`` words; empty if there is none."""
    last = F.size(ws) - (of - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), make)).otherwise(F.array())


def hashes(ws: Column, of: int = WORDS) -> Column:
    return shingles(ws, of, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(of)])).cast(
        "array<bigint>"
    )


def strings(ws: Column, of: int = WORDS) -> Column:
    return shingles(ws, of, lambda i: F.array_join(F.slice(ws, i, of), " ")).cast("array<string>")


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, q, item): the distinct shingles of each item, of width
    words; rows of one id and width are merged."""
    ws, width = F.col("ws"), F.least(F.size("ws"), F.lit(WORDS))
    whole_item = F.array(F.array_join(ws, " "))
    return (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("item_id"), words(whole(text_col)).alias("ws"))
        .where(F.size("ws") > 0)
        .select("item_id", width.alias("width"), F.explode(F.when(width == WORDS, strings(ws)).otherwise(whole_item)).alias("s"))
        .groupBy("item_id", "width")
        .agg(F.sort_array(F.collect_set("s")).alias("item"))
        .select("item_id", "width", F.size("item").alias("q"), "item")
    )


def sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, item_id, width, least): sketch hashes, and the shingles a document needs at least."""
    ws = F.split("s", " ")
    h = F.coalesce(
        *[F.when(F.col("width") == n, F.xxhash64(*[F.get(ws, k) for k in range(n)])) for n in range(1, WORDS + 1)]
    )
    every = written(
        sets.select("item_id", "width", "q", F.explode("item").alias("s")).select("item_id", "width", "q", h.alias("h")),
        "item-hashes",
    )
    m = (F.floor((1 - threshold) * F.col("q") + 1e-9) + 1).cast("int")
    least = F.ceil(threshold * F.col("q") - 1e-9).cast("int")
    # by the number of items, then by a second hash, so that the sketch is no subset by value of words
    rank = F.struct(F.col("n"), F.xxhash64("h").alias("o"), F.col("h"))
    return (
        every.join(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h")
        .groupBy("item_id", "width", "q")
        .agg(F.array_sort(F.collect_list(rank)).alias("ranked"))
        .select("item_id", "width", least.alias("least"), F.explode(F.slice("ranked", F.lit(1), m)).alias("r"))
        .select("item_id", "width", "least", F.col("r.h").alias("h"))
    )


def candidates(
    docs: DataFrame, sketch: DataFrame, widths: list[int], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, th, items): the items (item_id, width) of which a document holds a sketch hash."""
    if sketch.count() <= SENT:
        sketch = F.broadcast(sketch)
    text = whole(text_col)
    ws = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("ws")
    )
    found = F.concat(*[hashes(F.col("ws"), n) for n in widths]) if len(widths) > 1 else hashes(F.col("ws"), *widths)
    rows = ws.select("doc_id", "th", F.size("ws").alias("n_words"), F.explode(found).alias("dh"))
    large = F.col("n_words") - (F.col("width") - 1) >= F.col("least")
    return (
        rows.join(sketch, (F.col("dh") == F.col("h")) & large)
        .groupBy("doc_id", "th", "item_id", "width")
        .agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("item_id", "width")).alias("items"))
    )


def held(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, th, item_id, n_item, n_shared) of each row of docs (th: a hash of
    its text) that holds at least threshold of an item's distinct shingles."""
    sets = written(item_sets(items, item_id_col, item_text_col), "items")
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect())  # at most WORDS numbers
    sketch = written(sketches(sets, threshold), "sketches")
    found = written(candidates(docs, sketch, widths or [WORDS], id_col, text_col), "candidates")
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text")
    )
    ws = F.col("ws")
    doc = F.coalesce(*[F.when(F.col("x.width") == n, strings(ws, n)) for n in range(1, WORDS + 1)])
    return (
        rows.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")))
        .select("doc_id", "th", "items", words(F.col("_text")).alias("ws"))
        .select("doc_id", "th", "ws", F.explode("items").alias("x"))
        .select("doc_id", "th", "x.item_id", "x.width", doc.alias("doc"))
        .join(sets, ["item_id", "width"])
        .select(
            "doc_id", "th", "item_id", F.col("q").cast("long").alias("n_item"),
            F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared"),
        )
        .where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    )


def matches(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): documents that hold at
    least threshold of an item's distinct five-word shingles.

    Defined cases: null texts are empty; an item of under five words is one
    shingle of all its words; items without words, and items with a null id,
    match nothing; rows that repeat an item_id are one item of all their
    shingles (of each width); rows that repeat a doc_id give one row for each
    item, with the best containment; a null doc_id is reported as null; an empty
    table gives no rows; other columns are ignored.
    """
    best = F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item"))
    return (
        held(docs, items, threshold, id_col, text_col, item_id_col, item_text_col)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_shared")
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs without the rows whose text holds an item; of rows that repeat an id
    (or a null id) each is judged by its own text."""
    i, th = fresh(docs, "gone_id"), fresh(docs, "gone_th")
    gone = held(docs, items, threshold, id_col, text_col).select(
        F.col("doc_id").alias(i), F.col("th").alias(th)
    ).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(whole(text_col)) == F.col(th))
    return docs.join(gone, same, "left_anti")
