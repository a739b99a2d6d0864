"""Word search: token arrays, predicates and BM25 relevance."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F



def _latin() -> dict[str, str]:
    """Latin letters of one mark by the letter without it: those that Unicode
    decomposes into an ASCII letter and a single mark."""
    found = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower() and unicodedata.combining(parts[1]):
            found[c] = parts[0]
    return found


#: Combining marks that stand by themselves; they are dropped.
MARKS = "".join(map(chr, range(0x300, 0x332)))
ACCENTED = "".join(_latin())
FOLDED = "".join(_latin().values())
TOKEN = r"[\p{L}\p{N}\p{Co}+#.]+"
COLUMNS = ("title", "location", "department", "description")


def tokens(x: Column) -> Column:
    """Runs of letters, digits and + # . in lower case without Latin accents.

    A full stop belongs to its word: "Rust." is the token "rust.". Letters that
    are no accented ones in Unicode (ł, ø) stay, and so do those of two marks.
    """
    low = F.lower(F.coalesce(x, F.lit("")))
    # letters are looked up one by one, and there is nothing to fold in ASCII
    folded = F.when(F.octet_length(low) > F.char_length(low), F.translate(low, ACCENTED + MARKS, FOLDED)).otherwise(low)
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def with_tokens(df: DataFrame, columns=COLUMNS) -> DataFrame:
    """df with a token array <column>_tokens for each text column."""
    return df.withColumns({f"{c}_tokens": tokens(F.col(c)) for c in columns})


def _any(columns, make) -> Column:
    """make(tokens) for any of the columns. Tokens are bound to a variable, so
    that they are made once though make uses them for each of their places."""

    def bound(t: Column) -> Column:
        return F.get(F.transform(F.array(t), make), 0)

    return reduce(lambda a, b: a | b, [bound(F.col(f"{c}_tokens")) for c in columns])


def term(word: str, columns=COLUMNS) -> Column:
    """Some column holds the word as a whole token."""
    return _any(columns, lambda t: F.array_contains(t, word))


def any_term(words: list[str], columns=COLUMNS) -> Column:
    return _any(columns, lambda t: F.arrays_overlap(t, F.array(*[F.lit(w) for w in words])))


def prefix(start: str, columns=COLUMNS) -> Column:
    return _any(columns, lambda t: F.exists(t, lambda x: x.startswith(start)))


def phrase(words: list[str], columns=COLUMNS) -> Column:
    """The words in a row within one column."""
    k = len(words)

    def found(t: Column) -> Column:
        def here(i: Column) -> Column:
            return reduce(lambda x, y: x & y, [F.get(t, i + j) == w for j, w in enumerate(words)])

        starts = F.sequence(F.lit(0), F.size(t) - k)
        return F.when(F.size(t) >= k, F.exists(starts, here)).otherwise(False)

    return _any(columns, found)


def near(a: str, b: str, within: int, columns=COLUMNS) -> Column:
    """Both words in one column with at most ``within`` tokens between them."""

    def found(t: Column) -> Column:
        # the closest two are neighbours among all places of the words
        marked = F.transform(
            t, lambda x, i: F.when(x.isin(a, b), F.struct(i.alias("at"), (x == a).alias("first")))
        )
        here = F.array_compact(marked)
        pairs = F.zip_with(
            F.slice(here, 1, F.greatest(F.size(here) - 1, F.lit(0))),
            F.slice(here, 2, F.greatest(F.size(here) - 1, F.lit(0))),
            lambda x, y: (F.lit(a == b) | (x["first"] != y["first"])) & (y["at"] - x["at"] - 1 <= within),
        )
        return F.exists(pairs, lambda p: p)

    return _any(columns, found)


def near_all(phrases: list[list[str]], within: int, columns=COLUMNS) -> Column:
    """All phrases (lists of words) in one column, with at most ``within`` tokens
    from the end of each to the start of the last.

    One pass over the places of the phrases, in order: of each phrase the latest
    place counts, as an earlier one is only farther away.
    """
    firsts = sorted({p[0] for p in phrases})

    def found(t: Column) -> Column:
        def at(i: Column, k: int) -> Column:
            here = reduce(lambda a, b: a & b, [F.get(t, i + j) == w for j, w in enumerate(phrases[k])])
            return F.when(here, F.struct(i.alias("at"), F.lit(k).alias("k")))

        starts = F.array_compact(F.transform(t, lambda x, i: F.when(x.isin(firsts), i)))
        places = F.flatten(F.transform(starts, lambda i: F.array_compact(F.array(*[at(i, k) for k in range(len(phrases))]))))
        none = F.array(*[F.lit(None).cast("int") for _ in phrases])

        def step(state: Column, e: Column) -> Column:
            last = F.transform(state["last"], lambda old, k: F.when(k == e["k"], e["at"]).otherwise(old))
            close = reduce(
                lambda a, b: a & b,
                [F.coalesce(e["at"] - F.get(last, k) - len(p) <= within, F.lit(False)) for k, p in enumerate(phrases)],
            )
            return F.struct(last.alias("last"), (state["hit"] | close).alias("hit"))

        first = F.struct(none.alias("last"), F.lit(False).alias("hit"))
        return F.aggregate(places, first, step, lambda state: state["hit"])

    return _any(columns, found)


def equals(word: str):
    return lambda x: x == word


def bm25(df: DataFrame, words: list[str], columns=COLUMNS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """df with rank, lower is better: BM25 over all columns' tokens together.

    One aggregate gives the number of rows, the mean length and the rows that
    hold each word: a single row, which is broadcast.
    """
    all_ = F.flatten(F.array(*[F.col(f"{c}_tokens") for c in columns]))
    tf = [F.size(F.filter("_all", equals(w))) for w in words]
    rows = df.withColumn("_all", all_).withColumns(
        {"_len": F.size("_all"), **{f"_tf{i}": x for i, x in enumerate(tf)}}
    ).drop("_all")
    stats = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_len").alias("_mean"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))],
    )
    score = F.lit(0.0)
    for i in range(len(words)):
        df_, tf_ = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - df_ + 0.5) / (df_ + 0.5))
        score = score + idf * tf_ * (k1 + 1) / (tf_ + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return rows.crossJoin(F.broadcast(stats)).withColumn("rank", -score).select(*df.columns, "rank")
