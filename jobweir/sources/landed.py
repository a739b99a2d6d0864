"""Landed responses: outcomes, pages, entries, schemas, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.text import trimmed
from ..schemas import ENTRIES
from .scratch import written


def split_outcomes(landed: DataFrame) -> DataFrame:
    """landed with outcome: "stale" for 404, "failed" for other non-2xx, "ok"."""
    status = F.col("http_status")
    outcome = F.when(status == 404, "stale").when(status.between(200, 299), "ok").otherwise("failed")
    return landed.withColumn("outcome", outcome)


def assemble_pages(
    landed: DataFrame,
    total: Column,
    n_entries: Column,
    limit: int,
    total_from: str = "each",
    run: tuple[str, ...] = ("kind", "slug"),
) -> DataFrame:
    """The pages of each run that a reader of offsets 0, limit, ... would keep.

    Reading ends behind the first empty page, at a 404 that is not page 0, or
    where the next offset reaches the total: of the page just read ("each"), or
    of page 0, where 0 means no bound ("first"). Any other error, and a 404 on
    page 0, fails or stales the whole run: its pages go, ``run_outcomes`` tells.
    """
    marked = _marked(landed, total, n_entries, limit, total_from, run)
    return marked.where("run_outcome = 'ok' and not stopped and outcome = 'ok' and n_entries > 0").drop(
        "run_outcome", "stopped", "n_entries"
    )


def run_outcomes(
    landed: DataFrame, total: Column, n_entries: Column, limit: int, total_from: str = "each",
    run: tuple[str, ...] = ("kind", "slug"),
) -> DataFrame:
    """(run columns, outcome) of each run of pages."""
    marked = _marked(landed, total, n_entries, limit, total_from, run)
    return marked.groupBy(*run).agg(F.first("run_outcome").alias("outcome"))


def _marked(landed, total, n_entries, limit, total_from, run) -> DataFrame:
    w = Window.partitionBy(*run).orderBy("page_offset")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pages = split_outcomes(landed).withColumns({"n_entries": n_entries, "_total": F.coalesce(total, F.lit(0))})
    if total_from == "first":
        first = F.first("_total").over(w.rowsBetween(Window.unboundedPreceding, 0))
        bound = F.when(first > 0, first)
    else:
        bound = F.col("_total")
    stop = (
        F.coalesce(F.col("n_entries") == 0, F.lit(True))
        | (F.col("outcome") == "stale")
        | F.coalesce(F.col("page_offset") + limit >= bound, F.lit(False))
    )
    pages = pages.withColumn("_stop", stop.cast("int"))
    pages = pages.withColumn("stopped", F.coalesce(F.max("_stop").over(before), F.lit(0)) == 1)
    bad = (F.col("outcome") == "failed") & ~F.col("stopped")
    all_ = Window.partitionBy(*run)
    gone = F.max(((F.col("outcome") == "stale") & (F.col("page_offset") == 0)).cast("int")).over(all_)
    failed = F.max(bad.cast("int")).over(all_)
    outcome = F.when(gone == 1, "stale").when(failed == 1, "failed").otherwise("ok")
    return pages.withColumn("run_outcome", outcome).drop("_stop", "_total", "outcome").withColumn(
        "outcome", F.when(F.col("http_status").between(200, 299), "ok").otherwise("other")
    )


def once(x: Column) -> Column:
    """x as a row of its own, for a select: filters and fields that name it
    afterwards read it, where they would each work it out again."""
    return F.explode(F.array(x))


def listed() -> Column:
    """The list in body, as each row's kind has it: an array of JSON texts."""
    paths = sorted({path for path, _ in ENTRIES.values() if path})
    inner = F.from_json("body", ", ".join(f"{p} array<string>" for p in paths))
    out = F
    for kind, (path, _) in ENTRIES.items():
        out = out.when(F.col("kind") == kind, F.from_json("body", "array<string>") if path is None else inner[path])
    return out


def entry_of(kind: str) -> Column:
    """entry by the schema of a kind; its field _corrupt is not null if it does not fit."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return F.from_json("entry", ENTRIES[kind][1] + ", _corrupt string", options)


def entries(landed: DataFrame, kind: str) -> DataFrame:
    """(slug, fetched_at, page_offset, pos, e, raw_json): each entry of the list
    in a body, typed, with its JSON text; entries that do not fit the schema are
    dropped. A body without the list counts as empty."""
    path = ENTRIES[kind][0]
    found = (
        F.from_json("body", "array<string>")
        if path is None
        else F.from_json("body", f"{path} array<string>")[path]
    )
    rows = landed.where(F.col("kind") == kind).select(
        "slug", "fetched_at", "page_offset", F.posexplode(found).alias("pos", "entry")
    )
    return (
        rows.select("*", once(entry_of(kind)).alias("e"))
        .where(F.col("e._corrupt").isNull())
        .withColumn("raw_json", F.to_json(F.try_parse_json("entry")))
        .drop("entry")
    )


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """df with the columns of schema it lacks added, null or with a default;
    columns it has stay as they are, others behind them."""
    defaults = defaults or {}
    added = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in df.columns
    }
    return df.withColumns(added) if added else df


def url_list(lines: DataFrame) -> DataFrame:
    """(url) from lines of text (value): trimmed, without blank and # lines."""
    url = trimmed(F.col("value"))
    return lines.select(url.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path))


def resolve_redirects(df: DataFrame, redirects: DataFrame, url_col: str = "url") -> DataFrame:
    """df with final_url of redirects (url, final_url); rows without one go."""
    known = redirects.select(F.col("url").alias("_from"), "final_url").dropDuplicates(["_from"])
    return df.join(known, F.col(url_col) == F.col("_from")).drop("_from")


def redirect_ends(hops: DataFrame, most: int = 20) -> DataFrame:
    """(url, final_url, hops, outcome) of each url of single hops (url, next).

    Pointers are doubled: each round joins the rows that have not got to an end with
    all others on where they have got to, so a chain of n hops takes log2(n) rounds.
    A row keeps the least url of its way: one that is on the way to where it has
    got to and again on the next such stretch comes round again, so loops are found
    after about as many rounds as they are long, and what leads into one a round
    later. outcome is "ok", "too long" (more than most hops) or "loop"; final_url
    and hops are null for loops. Of hops that repeat a url the alphabetically first
    counts; null ones count not.
    """
    rows = hops.where("url is not null and next is not null").groupBy("url").agg(F.min("next").alias("at"))
    rows = rows.withColumns({"low": F.col("at"), "hops": F.lit(1).cast("bigint"), "done": F.lit(False), "loop": F.lit(False)})
    open_ = written(rows, "hops")
    ended, n, reach = [], open_.count(), 1
    while True:
        ahead = reduce(DataFrame.unionByName, ended, open_).select(F.col("url").alias("at"), *[F.col(c).alias(f"_{c}") for c in ("at", "low", "hops", "done", "loop")])
        moved = F.col("_at").isNotNull()
        again = moved & ~F.col("_done") & (F.col("low") == F.col("_low"))
        stepped = open_.join(ahead, "at", "left").select(
            "url", F.coalesce("_at", "at").alias("at"), F.least("low", "_low").alias("low"),
            (F.col("hops") + F.when(moved, F.col("_hops")).otherwise(0)).alias("hops"),
            F.when(moved, F.col("_done") | again).otherwise(True).alias("done"),
            F.when(moved, F.col("_loop") | again).otherwise(False).alias("loop"),
        )
        stepped = written(stepped, "hops")
        ended.append(stepped.where("done"))
        open_ = stepped.where("not done")
        reach *= 2
        if reach > n or open_.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, ended, open_).withColumn("loop", F.col("loop") | ~F.col("done"))
    outcome = F.when(F.col("loop"), "loop").when(F.col("hops") > most, "too long").otherwise("ok")
    return rows.select(
        "url", F.when(~F.col("loop"), F.col("at")).alias("final_url"), F.when(~F.col("loop"), F.col("hops")).alias("hops"), outcome.alias("outcome")
    )


def follow_redirects(df: DataFrame, ends: DataFrame, url_col: str = "url") -> DataFrame:
    """df with final_url by redirect_ends; a url without a hop is its own end, and
    rows whose chain has none go."""
    known = ends.select(F.col("url").alias("_from"), F.col("final_url").alias("_to"), "outcome")
    joined = df.join(known, F.col(url_col) == F.col("_from"), "left").where("outcome is null or outcome = 'ok'")
    return joined.withColumn("final_url", F.coalesce("_to", url_col)).drop("_from", "_to", "outcome")


def field_types(landed: DataFrame) -> DataFrame:
    """(kind, day, field, type, n): how many entries of the lists of a day have a
    field at their top, of which JSON type. Entries stay VARIANT, so fields that
    no adapter reads are seen as well."""
    entry = landed.where(F.col("http_status").between(200, 299)).select(
        "kind", F.to_date("fetched_at").alias("day"), F.explode(listed()).alias("entry")
    )
    rows = entry.select("kind", "day", F.try_parse_json("entry").alias("v")).where("v is not null")
    fields = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    json_type = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    simple = F.when(json_type.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(json_type)
    return (
        fields.where("key is not null").groupBy("kind", "day", F.col("key").alias("field"), simple.alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def drift(types: DataFrame) -> DataFrame:
    """(kind, day, field, change, before, after) between each day of a kind and its
    day before: "new" and "lost" fields, and "retyped" ones. Types are those of the
    values that are not null, in alphabetical order."""
    seen = types.where("type <> 'VOID'").groupBy("kind", "day", "field").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("type")
    )
    days = types.select("kind", "day").distinct()
    last = F.lag("day").over(Window.partitionBy("kind").orderBy("day"))
    days = days.withColumn("last", last).where("last is not null")
    now = days.join(seen, ["kind", "day"]).select("kind", "day", "field", F.col("type").alias("after"))
    old = days.join(seen.withColumnRenamed("day", "last"), ["kind", "last"]).select("kind", "day", "field", F.col("type").alias("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "lost").otherwise("retyped")
    both = now.join(old, ["kind", "day", "field"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("kind", "day", "field", change.alias("change"), "before", "after")
