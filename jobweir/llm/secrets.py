"""Secret scans with a trigram index.

Each rule is a regular expression. From its parse tree follows a Boolean query
over trigrams that every match must contain: an OR of clauses, each an AND of
trigrams (Cox, 2012). The inverted index lists, for each trigram that some
query mentions, the documents whose lower-cased text contains it. A rule's
candidates are the documents in the intersection of a clause's postings; only
they are moved and verified by the regular expression. Rules without mandatory
trigrams scan all texts, in one pass without a shuffle.

Index, intersection and verification are DataFrame operations. Places of
matches come from the texts between them: a running sum of lengths.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole, written


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group (0: all) has at least so many code points.
    group: int = 0
    least: int = 1


#: Fixed rules: the first three as stated, in their order, then the added ones.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # as [0-9a-f]+ of at least 24: runs are maximal either way
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
)
BASE = 3

# --- trigram queries --------------------------------------------------------

#: Strings of an alternative kept apart before they are cut into trigrams.
MOST = 64


def _strings(node) -> set[str] | None:
    """All lower-cased strings of a node, or None if they are too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found: set[str] = set()
        for kind, v in arg:
            if kind is sre.LITERAL:
                found.add(chr(v).lower())
            elif kind is sre.RANGE and v[1] - v[0] < 8:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found
    if op is sre.SUBPATTERN:
        return _all_strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_all_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _all_strings(arg[2])
        return None if inner is None else inner | {""}
    return None


def _all_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams of lower-cased text, one of which is in every match
    with all its trigrams; empty if nothing is mandatory.

    The runs of the pattern whose strings can be listed each give such an OR;
    the one whose shortest string is longest is taken.
    """
    runs: list[set[str]] = [{""}]
    for node in _flat(parser.parse(pattern)):
        more = _strings(node)
        if more is None or len(runs[-1]) * len(more) > MOST:
            runs.append({""} if more is None else more)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in more}
    best = max(runs, key=lambda run: min(map(len, run)))
    if min(map(len, best)) < 3:
        return []
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    # a clause that asks for more than another adds nothing to the OR
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _flat(nodes):
    for op, arg in nodes:
        if op is sre.SUBPATTERN and len(arg[-1]) != 1:
            yield from _flat(arg[-1])
        else:
            yield op, arg


# --- index ------------------------------------------------------------------


def trigram_index(
    docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Postings (trigram, doc_id, th): documents that contain a trigram, in
    lower case; th is a hash of the text."""
    text = whole(text_col)
    low = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.lower(text).alias("low")
    )
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(has).alias("trigram"), "doc_id", "th")


def candidates(index: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """(doc_id, th, rules): the numbers of the rules with a clause whose
    postings all hold the document."""
    terms = [
        (t, no, c, len(clause))
        for no, rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for t in sorted(clause)
    ]
    table = index.sparkSession.createDataFrame(terms, "trigram string, rule int, clause int, size int")
    return (
        index.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "th", "rule", "clause", "size")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = size")
        .groupBy("doc_id", "th")
        .agg(F.collect_set("rule").alias("rules"))
    )


# --- verification -----------------------------------------------------------


def _matches(text: Column, no: int, rule: Rule) -> Column:
    """STRUCT<rule, parts>: for each match the length of the text before it (since
    the last match), its own, and whether it counts."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    group = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    before = F.split(text, rule.pattern, -1)
    parts = F.zip_with(
        F.zip_with(
            before,
            found,
            lambda a, b: F.struct(
                F.char_length(a).cast("long").alias("gap"), F.char_length(b).cast("long").alias("size")
            ),
        ),
        group,
        lambda a, g: F.struct(
            a["gap"].alias("gap"), a["size"].alias("size"), (F.char_length(g) >= rule.least).alias("ok")
        ),
    )
    # the text after the last match has no match beside it
    parts = F.filter(parts, lambda x: x["size"].isNotNull())
    return F.when(text.rlike(rule.pattern), F.struct(F.lit(no).alias("rule"), parts.alias("parts")))


def spans(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, th, rule, start, end) of every match that counts; leftmost and
    without overlap for each rule; code points, end exclusive."""
    numbered = list(enumerate(rules))
    narrow = [(no, r) for no, r in numbered if trigram_query(r.pattern)]
    full = [(no, r) for no, r in numbered if not trigram_query(r.pattern)]
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    found = []
    if full:
        each = F.array_compact(F.array(*[_matches(F.col("text"), no, r) for no, r in full]))
        found.append(rows.select("doc_id", "th", F.explode(each).alias("m")))
    if narrow:
        trigrams = sorted({t for _, r in narrow for c in trigram_query(r.pattern) for t in c})
        index = written(trigram_index(docs, trigrams, id_col, text_col), "trigrams")
        maybe = written(candidates(index, narrow), "secret-candidates").select(
            F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "rules"
        )
        each = F.array_compact(
            F.array(
                *[
                    F.when(F.array_contains("rules", no), _matches(F.col("text"), no, r))
                    for no, r in narrow
                ]
            )
        )
        joined = rows.join(
            maybe, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
        )
        found.append(joined.select("doc_id", "th", F.explode(each).alias("m")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # rows that repeat a document give its spans once
    every = every.select("doc_id", "th", F.col("m.rule").alias("rule"), F.posexplode("m.parts").alias("i", "p"))
    every = every.groupBy("doc_id", "th", "rule", "i").agg(F.first("p").alias("p"))
    so_far = Window.partitionBy("doc_id", "th", "rule").orderBy("i")
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(so_far)
    return (
        every.withColumn("end", end)
        .where("p.ok")
        .select("doc_id", "th", "rule", (F.col("end") - F.col("p.size")).alias("start"), "end")
    )


def scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, found): for every row of docs its spans, an array of
    STRUCT<start, rule, end> in order.

    Defined cases: null and empty texts have no spans; rows that repeat an id
    are told apart by their text; a null id is reported as null; an empty table
    gives no rows; other columns are ignored.
    """
    by_doc = (
        spans(docs, rules, id_col, text_col)
        .groupBy("doc_id", "th")
        .agg(F.sort_array(F.collect_list(F.struct("start", "rule", "end"))).alias("found"))
        .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "found")
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("th")
    )
    return rows.join(
        written(by_doc, "secret-spans"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")),
        "left",
    ).select("doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("found"))


def named(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def count_of(found: Column, rule: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rule"] == rule)).cast("long")
