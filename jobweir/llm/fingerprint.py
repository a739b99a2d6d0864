"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is a multiset of paragraphs, its lines as they stand. Each is hashed to a
vector of LANES numbers of BITS bits (SHA-256, extended); the fingerprint begins
with their sum in each lane, modulo 2 ** BITS. So

* the order of paragraphs does not count, and equal multisets have equal sums;
* a paragraph is added or removed by adding or subtracting its vector: ``plus``
  and ``minus`` give the fingerprint of an edited text without reading the rest;
* multisets that differ, by any number of copies, have equal sums with a chance
  of about 2 ** -(BITS * LANES - log2 of the copies).

Uniform lanes say equal or not, no more. So a second part, summed and edited in
the same way, has the number of sentences and, in SKETCH lanes, how many of them
have a 1 in one bit of their hash. Ones less zeros are sums of +1 and -1, and
the cosine of two such vectors estimates that of the multisets of sentences
(error about 1 / sqrt(SKETCH)): how much two texts share.

All of it is DataFrame operations: hashing and sums are array functions within
a row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole, written

LANES, BITS = 8, 60
MASK = (1 << BITS) - 1
#: Words of a sentence's hash, and bits between the two counts in one number: a
#: count is exact up to 2 ** 30 sentences.
WORDS, HALF = 2, BITS // 2
SKETCH = WORDS * BITS
#: Ones at the two places of a number that are counted together.
PAIR = (1 << HALF) + 1
#: A sentence end and the blanks after it, which become a line end.
ENDS = r"([.!?])[ \t]+"
DIGITS = BITS // 4


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    """Sentences of all lines, without those that are empty."""
    return F.array_remove(F.split(F.regexp_replace(text, ENDS, "$1\n"), "\n", -1), "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once for the row though use has it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _numbers(digest: Column, n: int) -> list[Column]:
    """The first n numbers of BITS bits of a digest in hexadecimal."""
    return [F.conv(F.substring(digest, DIGITS * i + 1, DIGITS), 16, 10).cast("bigint") for i in range(n)]


def _sum(column: Column, of) -> Column:
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda n, x: of(n, x))


def vector(paragraphs: Column, sentences: Column) -> Column:
    """LANES sums of paragraphs, the number of sentences, and their bit counts."""
    half = LANES // 2

    def sums(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(LANES - 1)),
            lambda i: _sum(hashes, lambda n, x: (n + F.get(x, i)).bitwiseAND(F.lit(MASK))),
        )

    def counts(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(HALF - 1)),
            lambda b: _sum(word, lambda n, x: n + F.call_function("shiftright", x, b).bitwiseAND(F.lit(PAIR))),
        )

    digests = F.transform(
        paragraphs, lambda p: F.struct(F.sha2(p, 256).alias("a"), F.sha2(F.concat(F.lit("1"), p), 256).alias("b"))
    )
    own = let(
        F.transform(digests, lambda d: F.array(*_numbers(d["a"], half), *_numbers(d["b"], half))), sums
    )
    words = F.transform(F.transform(sentences, F.md5), lambda d: F.array(*_numbers(d, WORDS)))
    sketch = let(
        words,
        lambda ws: F.flatten(F.array(*[let(F.transform(ws, lambda x: F.get(x, w)), counts) for w in range(WORDS)])),
    )
    return F.concat(own, F.array(F.size(sentences).cast("bigint")), sketch)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def printed(v: Column) -> Column:
    """A vector as text: fifteen hexadecimal digits a number."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), DIGITS, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the sketches, 0 to 1; of equal vectors 1, of no sentences and some 0."""

    def lanes(v: Column) -> Column:
        n = F.get(v, LANES)
        return F.flatten(
            F.transform(
                F.slice(v, LANES + 2, SKETCH // 2),
                lambda x: F.array(
                    2 * x.bitwiseAND(F.lit((1 << HALF) - 1)) - n, 2 * F.shiftright(x, HALF) - n
                ),
            )
        )

    def dot(x: Column, y: Column) -> Column:
        return _sum(F.zip_with(x, y, lambda p, q: p * q), lambda s, v: s + v).cast("double")

    def cosine(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(lanes(a).alias("x"), lanes(b).alias("y")), cosine))


# --- neighbours in id order -------------------------------------------------


def in_order(rows: DataFrame) -> DataFrame:
    """(doc_id, h, copies, prev) of each document and text of rows (doc_id, h,
    size): how many rows it has, and the (doc_id, h, size) of the one before it
    in descending doc_id, then h; before the first comes the last.

    Only ids and hashes are sorted, by range partitions. Each is numbered by
    itself, and its first row takes the last of the partition before from a
    table of one row a partition.
    """
    order = (F.col("doc_id").desc_nulls_last(), F.col("h"))
    groups = rows.groupBy("doc_id", "h").agg(
        F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")
    )
    placed = written(
        groups.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "order",
    ).withColumn("block", F.shiftright("at", 33))  # the number of the partition
    me = F.struct("doc_id", "h", "size")
    ends = placed.groupBy("block").agg(F.max_by(me, "at").alias("end"))
    chain = Window.orderBy("block")
    before = written(
        ends.select(
            F.col("block").alias("_block"),
            F.coalesce(F.lag("end").over(chain), F.max_by("end", "block").over(Window.partitionBy())).alias("end"),
        ),
        "order-ends",
    )
    inside = F.lag(me).over(Window.partitionBy("block").orderBy("at"))
    return (
        placed.withColumn("inside", inside)
        .join(before, F.col("block") == F.col("_block"))
        .select("doc_id", "h", "copies", F.coalesce("inside", "end").alias("prev"))
    )


def with_next(rows: DataFrame, derive) -> DataFrame:
    """rows (doc_id, text) with what derive(rows) adds as "vector", and of the
    row that follows in descending doc_id (after the last: the first) as much of
    the text as the edit takes, "head", and "next_vector".

    Rows meet their place in the order by an equi join, and send their start to
    the row before by another; a frequent id falls apart by its texts' hashes,
    and equal rows are one until the end. Both sides of the second join read the
    columns of rows that the first has dealt out, so Spark deals them out once.
    """
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = F.char_length("text").alias("size")
    order = written(in_order(rows.select("doc_id", "h", size)), "order-prev")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    keyed = derive(rows).join(
        order.withColumnsRenamed({"doc_id": "_id", "h": "_h"}), same
    ).drop("_id", "_h")
    repeated = not order.where("copies > 1").isEmpty()
    if repeated:
        many = keyed.where("copies > 1").dropDuplicates(["doc_id", "h"])
        keyed = keyed.where("copies = 1").unionByName(many)
    heads = keyed.select(
        F.col("prev.doc_id").alias("_id"),
        F.col("prev.h").alias("_h"),
        F.substring("text", F.lit(1), F.floor(F.col("prev.size") / 3).cast("int")).alias("head"),
        F.col("vector").alias("next_vector"),
    )
    keyed = keyed.drop("prev").join(heads, same).drop("_id", "_h", "h")
    if repeated:  # all copies but the last are followed by one of themselves
        again = keyed.where("copies > 1").withColumns(
            {
                "head": F.substring("text", F.lit(1), F.floor(F.char_length("text") / 3).cast("int")),
                "next_vector": F.col("vector"),
                "copies": F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("copies"))),
            }
        )
        keyed = keyed.unionByName(again)
    return keyed.drop("copies")


def edited(text: Column, n: Column, after: Column) -> Column:
    """The last floor(n / 3) code points replaced by the first as many of after."""
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(after, F.lit(1), k))


def _changed(old: Column, new: Column):
    """The ends of two lists from where they first differ."""
    differ = F.array_position(F.zip_with(old, new, lambda x, y: x.eqNullSafe(y)), False)
    # where one list is the start of the other, nothing differs up to its end
    at = F.when(differ > 0, differ).otherwise(F.least(F.size(old), F.size(new)) + 1).cast("int")
    return [F.slice(x, at, F.greatest(F.size(x), F.lit(1))) for x in (old, new)]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses.

    An edited text's fingerprint is that of the text, less the paragraphs and
    sentences that the edit took, plus those it brought.

    Defined cases: null texts are empty, an empty text is one empty paragraph;
    rows with a null id come last; rows that repeat an id stand side by side,
    ordered by a hash of the text; a table of one row is its own next; an empty
    table gives no rows; texts of any length are read whole; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    text, new = F.col("text"), F.col("edited")
    rows = with_next(rows, lambda d: d.withColumn("vector", vector(paragraphs(text), sentences(text))))
    rows = rows.withColumn("size", F.char_length("text"))
    rows = rows.withColumn("edited", edited(text, F.col("size"), F.col("head")))
    rows = rows.withColumns(
        {"p0": paragraphs(text), "p1": paragraphs(new), "s0": sentences(text), "s1": sentences(new)}
    )
    for of in "ps":
        gone, come = _changed(F.col(f"{of}0"), F.col(f"{of}1"))
        rows = rows.withColumns({f"{of}0": gone, f"{of}1": come})
    kept = minus(F.col("vector"), vector(F.col("p0"), F.col("s0")))
    rows = rows.select(
        "doc_id",
        "size",
        "vector",
        "next_vector",
        F.sha2("edited", 256).alias("edited_sha256"),
        plus(kept, vector(F.col("p1"), F.col("s1"))).alias("edited_vector"),
    )
    return rows.select(
        "doc_id",
        F.col("size").cast("long").alias("n_chars"),
        "edited_sha256",
        printed(F.col("vector")).alias("fingerprint"),
        printed(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
