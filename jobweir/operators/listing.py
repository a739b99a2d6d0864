"""Listings of jobs and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import age_text, tags_text
from ..functions.match import bm25
from ..functions.text import ascii_lower
from . import textindex
from .merge import numbered


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("closed_at").isNull())


def by_status(jobs: DataFrame, show: str = "active") -> DataFrame:
    """show: "active" hides dismissed jobs, "all" none, "applied" all but those."""
    if show == "all":
        return jobs
    return jobs.where(F.col("status") == "applied" if show == "applied" else F.col("status") != "dismissed")


def page(df: DataFrame, limit: int | None = None, start: int = 0) -> DataFrame:
    """Rows start .. start + limit of an ordered frame; no limit for None."""
    if start:
        df = df.offset(start)
    return df if limit is None else df.limit(limit)


def list_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    now_seconds: Column,
    remote: bool = False,
    show: str = "active",
    match: Column | None = None,
    words: list[str] | None = None,
    corpus: textindex.Corpus | None = None,
    limit: int | None = None,
    start: int = 0,
) -> DataFrame:
    """Open jobs with their company, oldest posting first, unknown dates last.

    match is a predicate on token columns (functions.match); with words the
    third key is their relevance instead of last_seen. Relevance is that within
    all of jobs, closed and hidden ones included: of corpus, the statistics kept
    for the words (textindex.corpus), or else counted here. Order: posted_at as
    text, then last_seen, the newest first, then id.
    """
    if words:
        jobs = bm25(jobs, words) if corpus is None else textindex.ranked(jobs, corpus, words)
    rows = by_status(open_jobs(jobs), show)
    if remote:
        rows = rows.where("remote")
    keys = [F.col("posted_at").asc_nulls_last()]
    if match is not None:
        rows = rows.where(match)
    if words:
        keys.append(F.col("rank").asc())
    else:
        keys.append(F.col("last_seen").desc())
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    rows = rows.join(c, "company_id").select(
        "id",
        "company",
        "title",
        F.coalesce("location", F.lit("")).alias("location"),
        "apply_url",
        "posted_at",
        "last_seen",
        *(["rank"] if words else []),
        age_text(F.col("posted_at"), now_seconds).alias("age"),
        tags_text(F.col("remote"), F.col("status")).alias("tags"),
    )
    return page(rows.orderBy(*keys, F.col("id").asc()), limit, start)


def after(jobs: DataFrame, limit: int, cursor: dict | None = None) -> DataFrame:
    """The next rows of a listing in the order of list_jobs, behind the row that
    cursor is (posted_at, last_seen, id). The rows before it are filtered out where
    they are read, and each task keeps limit rows at most, however deep the page."""
    order = [F.col("posted_at").asc_nulls_last(), F.col("last_seen").desc(), F.col("id").asc()]
    if cursor is None:
        return jobs.orderBy(*order).limit(limit)
    posted, seen, id_ = (F.lit(cursor[c]) for c in ("posted_at", "last_seen", "id"))
    later = (F.col("last_seen") < seen) | (F.col("last_seen") == seen) & (F.col("id") > id_)
    if cursor["posted_at"] is None:
        behind = F.col("posted_at").isNull() & later
    else:
        behind = F.col("posted_at").isNull() | (F.col("posted_at") > posted) | (F.col("posted_at") == posted) & later
    return jobs.where(behind).orderBy(*order).limit(limit)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, 0 for the first in order: written once, sorted by ranges,
    so that any page is a filter on place that reads the files that hold it."""
    return numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order), -1, "place")


def page_at(placed_rows: DataFrame, page: int, size: int) -> DataFrame:
    """Page number page (from 0) of placed rows."""
    return placed_rows.where(F.col("place").between(page * size, page * size + size - 1))


def by_company(jobs: DataFrame, companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies with an array of their open jobs, of any status; both in
    case-blind order of name and title, then id."""
    opened = open_jobs(jobs)
    chosen = companies.join(opened.select(F.col("company_id").alias("id")), "id", "left_semi")
    chosen = page(chosen.orderBy(ascii_lower(F.col("name")), "id"), limit)
    job = F.struct(
        ascii_lower(F.col("title")).alias("k"), F.col("id").alias("id"), "title",
        F.coalesce("location", F.lit("")).alias("location"), "apply_url",
    )
    nested = opened.groupBy("company_id").agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    return chosen.join(nested, chosen.id == nested.company_id).select(
        "id", "name", "ats_kind", "ats_slug", F.transform("jobs", lambda j: j.dropFields("k")).alias("jobs")
    )


def list_companies(companies: DataFrame, limit: int | None = None) -> DataFrame:
    rows = companies.select("ats_kind", "ats_slug", "name", "last_seen", "id")
    return page(rows.orderBy(F.col("last_seen").desc(), "id"), limit)


def open_recent(jobs: DataFrame, companies: DataFrame, limit: int | None = None) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    rows = open_jobs(jobs).join(c, "company_id").select(
        "id", "company", "title", F.coalesce("location", F.lit("")).alias("location"), "apply_url", "last_seen"
    )
    return page(rows.orderBy(F.col("last_seen").desc(), "id"), limit)


def of_kind(companies: DataFrame, kind: str) -> DataFrame:
    return companies.where(F.col("ats_kind") == kind).select("id", "name", "ats_slug").orderBy("ats_slug", "id")


def by_kind(companies: DataFrame) -> DataFrame:
    """Companies grouped by kind, in order of kind, then id: (ats_kind, n, id,
    ats_slug), n the companies of the kind. Groups stay rows, whatever their size."""
    sizes = companies.groupBy("ats_kind").agg(F.count(F.lit(1)).alias("n"))
    rows = companies.select("ats_kind", "id", "ats_slug").join(sizes, "ats_kind")
    return rows.select("ats_kind", "n", "id", "ats_slug").orderBy("ats_kind", "id")


def find_slug(companies: DataFrame, slug: str, kind: str | None = None) -> DataFrame:
    rows = companies.where(F.col("ats_slug") == slug)
    return rows if kind is None else rows.where(F.col("ats_kind") == kind)


def totals(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    n = companies.agg(F.count(F.lit(1)).alias("companies"))
    return n.crossJoin(open_jobs(jobs).agg(F.count(F.lit(1)).alias("open_jobs")))
