"""Counters of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _count(x: Column, name: str) -> Column:
    return F.count_if(x).alias(name)


def crawl_report(pages: DataFrame, group=("source",)) -> DataFrame:
    """pages has one row for each page visited: apply_url, matched,
    job_is_new, company_is_new."""
    return pages.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pages_visited"),
        _count(F.col("apply_url").isNotNull(), "apply_links_found"),
        _count(F.col("matched"), "jobs_matched"),
        _count(F.col("job_is_new"), "jobs_new"),
        _count(F.col("company_is_new"), "companies_new"),
    )


def sync_report(companies: DataFrame, postings: DataFrame, merged: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """By kind. companies (kind, outcome), postings (kind) each input row,
    merged (kind, change), closed (kind). Without closed, merged has each job of
    the merge with closed (boolean) beside change, so that it is read once."""
    one = F.lit(0).cast("bigint")
    names = ("companies_synced", "companies_404", "jobs_seen", "jobs_new", "jobs_closed")

    def part(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("kind", *[columns.get(n, one).cast("bigint").alias(n) for n in names])

    new = F.col("change") == "new"
    rows = part(companies, companies_synced=F.col("outcome") == "ok", companies_404=F.col("outcome") == "stale").unionByName(
        part(postings, jobs_seen=F.lit(1))
    )
    if closed is None:
        rows = rows.unionByName(part(merged.where(new | F.col("closed")), jobs_new=new, jobs_closed=F.col("closed")))
    else:
        rows = rows.unionByName(part(merged, jobs_new=new)).unionByName(part(closed, jobs_closed=F.lit(1)))
    return rows.groupBy("kind").agg(*[F.coalesce(F.sum(n), one).alias(n) for n in names])


def discover_report(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """By kind. queries (kind) as sent; hits (kind, url, hit_kind, slug,
    company_is_new): hit_kind null where no platform is known."""
    sent = queries.groupBy("kind").agg(F.count(F.lit(1)).alias("queries_sent"))
    same = F.coalesce(F.col("hit_kind") == F.col("kind"), F.lit(False))
    seen = hits.groupBy("kind").agg(
        F.count(F.lit(1)).alias("urls_seen"),
        _count(same, "urls_classified"),
        F.count_distinct(F.when(same, F.col("slug"))).alias("companies_seen"),
        F.count_distinct(F.when(same & F.col("company_is_new"), F.col("slug"))).alias("companies_new"),
    )
    return sent.join(seen, "kind", "left").na.fill(0)


def import_report(urls: DataFrame, companies: DataFrame) -> DataFrame:
    """urls (seq, ref): of a batch, how many companies are new, rows known
    (also those that repeat a new one), rows skipped; items_seen = new + known."""
    known = companies.select("ats_kind", "ats_slug").distinct().withColumn("_known", F.lit(True))
    rows = urls.select(F.col("ref.kind").alias("ats_kind"), F.col("ref.slug").alias("ats_slug"))
    by_key = rows.groupBy("ats_kind", "ats_slug").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_key.join(known, ["ats_kind", "ats_slug"], "left")
    skip, new = F.col("ats_kind").isNull(), F.col("ats_kind").isNotNull() & F.col("_known").isNull()
    zero = F.lit(0).cast("bigint")
    out = by_key.agg(
        F.coalesce(F.sum(new.cast("bigint")), zero).alias("companies_new"),
        F.coalesce(F.sum(F.when(~skip, F.col("n") - new.cast("bigint"))), zero).alias("already_known"),
        F.coalesce(F.sum(F.when(skip, F.col("n"))), zero).alias("skipped"),
    )
    return out.withColumn("items_seen", F.col("companies_new") + F.col("already_known"))


def mark_report(marks: DataFrame, jobs: DataFrame) -> DataFrame:
    """How many ids of a call could be marked."""
    rows = marks.join(jobs.select("id", F.lit(True).alias("_there")), "id", "left")
    return rows.agg(
        F.count_if(F.col("_there").isNotNull()).alias("ok"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_there").isNull()).alias("failed"),
    )


def batch_outcome(runs: DataFrame, stop_at_first: bool) -> DataFrame:
    """runs (pos, source, ok) with ran: all of them, or those up to the first
    failure; the batch has failed if any that ran has."""
    bad = runs.where(~F.col("ok")).agg(F.min("pos").alias("_bad"))
    ran = (
        F.col("_bad").isNull() | (F.col("pos") <= F.col("_bad")) if stop_at_first else F.lit(True)
    )
    return runs.crossJoin(F.broadcast(bad)).withColumns(
        {"ran": ran, "batch_ok": F.col("_bad").isNull()}
    ).drop("_bad")


def source_health(runs: DataFrame) -> DataFrame:
    """By source: runs, how many went well, the last state, items seen and new."""
    return runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("ok")).alias("ok_runs"),
        F.max_by("ok", F.struct("started_at", "run_id")).alias("last_ok"),
        F.sum("items_seen").alias("items_seen"),
        F.sum("items_new").alias("items_new"),
    )


def failure_streaks(runs: DataFrame) -> DataFrame:
    """By source: failing_for, the failures since the last run that went well;
    longest, the longest row of failures ever; since, when the current one began.

    A day's runs are folded first, and then the days, so that no task sorts all
    runs of a source: what is kept of a stretch of runs is its length, the
    failures it begins and ends with, and the most in a row.
    """
    one = F.struct("started_at", "run_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    shape = "struct<n:bigint,head:bigint,tail:bigint,most:bigint,since:timestamp>"
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "head", "tail", "most")], F.lit(None).cast("timestamp").alias("since"))

    def alone(r: Column) -> Column:
        bad = F.when(r["ok"], 0).otherwise(1).cast("bigint")
        since = F.when(~r["ok"], r["started_at"].cast("timestamp"))
        return F.struct(F.lit(1).cast("bigint").alias("n"), bad.alias("head"), bad.alias("tail"), bad.alias("most"), since.alias("since"))

    def then(a: Column, b: Column) -> Column:
        all_a, all_b = a["head"] == a["n"], b["head"] == b["n"]
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            (a["head"] + F.when(all_a, b["head"]).otherwise(0)).alias("head"),
            (b["tail"] + F.when(all_b, a["tail"]).otherwise(0)).alias("tail"),
            F.greatest(a["most"], b["most"], a["tail"] + b["head"]).alias("most"),
            F.when(all_b, F.coalesce(a["since"], b["since"])).otherwise(b["since"]).alias("since"),
        ).cast(shape)

    days = runs.groupBy("source", F.to_date("started_at").alias("day")).agg(F.array_sort(F.collect_list(one)).alias("rs"))
    days = days.select("source", "day", F.aggregate("rs", zero.cast(shape), lambda acc, r: then(acc, alone(r).cast(shape))).alias("s"))
    whole = days.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("day", "s"))).alias("ds"))
    folded = whole.select("source", F.aggregate("ds", zero.cast(shape), lambda acc, d: then(acc, d["s"])).alias("s"))
    return folded.select("source", F.col("s.tail").alias("failing_for"), F.col("s.most").alias("longest"), F.col("s.since").alias("since"))


def daily_health(runs: DataFrame, days: int = 7) -> DataFrame:
    """(source, day, runs, ok_runs, share): runs of a day, and the share of all
    that went well in the days up to it, days of the calendar with and without runs."""
    by_day = runs.groupBy("source", F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok")).alias("ok_runs")
    )
    span = Window.partitionBy("source").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return by_day.withColumn("share", F.sum("ok_runs").over(span) / F.sum("runs").over(span))
