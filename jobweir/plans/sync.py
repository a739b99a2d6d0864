"""Runs that change the state: syncs of landed posting lists, imports of URLs.

A run takes snapshots and landed input and returns the next snapshots with its
report and its rows for the run log; nothing is fetched here. All companies of
all kinds go in one pass. What several results need is written once (the verdict
on each landed page, the postings, the companies that a list names); snapshots
are not, they are read by the caller's write alone.

The landed table is read twice: once for the verdict on each page, which keeps
no body, and once for the bodies of the pages that are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import classify
from ..operators import merge, reports
from ..schemas import ENTRIES
from ..sources.adapters import normalise
from ..sources.landed import once, url_list
from ..sources.scratch import written
from .pipelines import cleaned

#: Kinds whose lists come in pages: page size, the field with the total, and
#: whether each page says it or only the first (fixed values).
PAGED = {"smartrecruiters": (100, "totalFound", "each"), "workday": (20, "total", "first")}

PAGE = ["kind", "slug", "page_offset", "fetched_at", "body_hash"]


class Fetched(NamedTuple):
    """pages: PAGE of the responses to read; outcomes: (kind, slug, outcome, started_at)."""

    pages: DataFrame
    outcomes: DataFrame


class Synced(NamedTuple):
    jobs: DataFrame
    report: DataFrame
    runs: DataFrame


class Imported(NamedTuple):
    companies: DataFrame
    discoveries: DataFrame
    report: DataFrame
    run: DataFrame
    jobs: DataFrame
    sync_report: DataFrame


class Crawled(NamedTuple):
    companies: DataFrame
    discoveries: DataFrame
    jobs: DataFrame
    run: DataFrame


def _by_kind(values: dict[str, Column], default: Column) -> Column:
    out = F
    for kind, value in values.items():
        out = out.when(F.col("kind") == kind, value)
    return out.otherwise(default)


def _named(landed: DataFrame) -> DataFrame:
    """landed with what names a page's response: page_offset 0 where it has none,
    and a hash of the body."""
    return landed.withColumns({"page_offset": F.coalesce("page_offset", F.lit(0)), "body_hash": F.xxhash64("body")})


def fetched(landed: DataFrame) -> Fetched:
    """landed (kind, slug, fetched_at, http_status, page_offset, body) of one
    run: what a reader of each list keeps, and how each company went.

    A page that was fetched again counts as it was fetched last, so a retry mends
    a failure. A company whose run failed or is stale keeps no page at all. A
    list in one response has its page whatever it holds; one in pages ends as
    ``assemble_pages`` tells.
    """
    inner = sorted({ENTRIES[k][0] for k in PAGED})
    says = F.from_json("body", ", ".join([f"{t} bigint" for _, t, _ in PAGED.values()] + [f"{p} array<string>" for p in inner]))
    total = _by_kind({k: F.coalesce(F.col("says")[t], F.lit(0)) for k, (_, t, _) in PAGED.items()}, F.lit(0))
    n = _by_kind({k: F.greatest(F.size(F.col("says")[ENTRIES[k][0]]), F.lit(0)) for k in PAGED}, F.lit(0))
    rows = _named(landed.where(F.col("kind").isin(*ENTRIES))).select(
        *PAGE, "http_status", once(F.when(F.col("kind").isin(*PAGED), says)).alias("says")
    )
    # dealt by run at once: both the last answers and the windows below are worked out where they lie
    rows = rows.select(*PAGE, "http_status", total.alias("total"), n.alias("n_entries")).repartition("kind", "slug")
    good = F.col("http_status").between(200, 299)
    last = F.struct(F.col("fetched_at").alias("at"), F.coalesce(good, F.lit(False)).alias("good"), "n_entries", F.col("body_hash").alias("hash"))
    pages = rows.groupBy("kind", "slug", "page_offset").agg(
        F.max_by(F.struct("fetched_at", "body_hash", "http_status", "total", "n_entries"), last).alias("p"),
        F.min("fetched_at").alias("began"),
    ).select("kind", "slug", "page_offset", "began", "p.*")

    whole = Window.partitionBy("kind", "slug")
    ordered = whole.orderBy("page_offset")
    paged, limit = F.col("kind").isin(*PAGED), _by_kind({k: F.lit(v[0]) for k, v in PAGED.items()}, F.lit(1))
    first = F.first("total").over(ordered)
    bound = _by_kind({k: F.col("total") if v[2] == "each" else F.when(first > 0, first) for k, v in PAGED.items()}, F.lit(None))
    gone = F.col("http_status") == 404
    ends = paged & ((F.col("n_entries") == 0) | gone | F.coalesce(F.col("page_offset") + limit >= bound, F.lit(False)))
    pages = pages.withColumns({"ok": F.coalesce(good, F.lit(False)), "ends": F.coalesce(ends, F.lit(False))})
    beyond = F.coalesce(F.max("ends").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    pages = pages.withColumn("beyond", beyond)
    stale = F.max(gone & (~paged | (F.col("page_offset") == 0))).over(whole)
    failed = F.max(~F.col("ok") & ~F.coalesce(gone, F.lit(False)) & ~F.col("beyond")).over(whole)
    outcome = F.when(stale, "stale").when(failed, "failed").otherwise("ok")
    pages = pages.withColumn("outcome", outcome)
    kept = (F.col("outcome") == "ok") & F.col("ok") & ~F.col("beyond") & (~paged | (F.col("n_entries") > 0))
    verdict = written(pages.select(*PAGE, "began", "outcome", kept.alias("kept")), "pages")
    outcomes = verdict.groupBy("kind", "slug").agg(F.first("outcome").alias("outcome"), F.min("began").alias("started_at"))
    return Fetched(verdict.where("kept").select(*PAGE), outcomes)


def bodies(landed: DataFrame, pages: DataFrame) -> DataFrame:
    """The landed responses that pages (PAGE) names."""
    rows = _named(landed)
    same = [rows[c].eqNullSafe(pages[c]) if c == "fetched_at" else rows[c] == pages[c] for c in PAGE]
    return rows.join(pages, same, "left_semi")


def last_id(table: DataFrame) -> int:
    """The greatest id of a snapshot, 0 if it has none. Who keeps it elsewhere
    (streams do) need not ask."""
    return table.agg(F.max("id")).first()[0] or 0


def _merged_jobs(jobs: DataFrame, rows: DataFrame, seq: Column, now: Column, start: int | None) -> DataFrame:
    """jobs with rows merged in; new jobs are numbered on from start."""
    start = last_id(jobs) if start is None else start
    ids = merge.numbered(merge.new_keys(rows, jobs, merge.JOB_KEY), start)
    policy = merge.JOB_POLICY | {"id": "keep"}
    return merge.upsert_jobs(jobs, rows.join(ids, list(merge.JOB_KEY), "left"), seq, now, policy=policy)


def sync(landed: DataFrame, companies: DataFrame, jobs: DataFrame, now: Column, start: int | None = None) -> Synced:
    """Merge the landed lists of known companies into jobs.

    Companies whose fetch went well have all unseen open jobs closed, also where
    their list is empty; failed and stale ones are left as they are, and what has
    landed of them is not merged. Landed lists of unknown companies are passed
    over. jobs comes back with change ("new", "known" or null); new jobs are
    numbered on from start, or else from the greatest id of jobs. runs has a row
    for each kind, for the run log.
    """
    ids = companies.select(F.col("id").alias("company_id"), F.col("ats_kind").alias("kind"), F.col("ats_slug").alias("slug"))
    keys = ["kind", "slug"]
    known = landed.join(ids.select(*keys), keys, "left_semi")
    got = fetched(known)
    runs = got.outcomes.join(ids, keys)
    # pages names known companies only; postings are wide and their size is hard to foresee, so they are never sent whole
    postings = cleaned(normalise(bodies(landed, got.pages))).join(ids.hint("shuffle_hash"), keys).withColumnRenamed("kind", "ats_kind")
    postings = written(postings, "postings")
    out = _merged_jobs(jobs, postings, F.struct("fetched_at", "slug", "page_offset", "pos"), now, start)
    done = runs.where("outcome = 'ok'").select("company_id", F.col("kind").alias("ats_kind"), "started_at")
    swept = merge.sweep(out.withColumn("was_open", F.col("closed_at").isNull()), done, now)
    kind = F.col("ats_kind").alias("kind")
    changes = swept.select(kind, "change", (F.col("was_open") & F.col("closed_at").isNotNull()).alias("closed"))
    report = reports.sync_report(runs.select("kind", "outcome"), postings.select(kind), changes)
    began = runs.groupBy("kind").agg(F.min("started_at").alias("began"))
    rows = merge.run_row(
        report.join(began, "kind", "left"), F.concat(F.lit("sync:"), F.col("kind")), F.coalesce("began", now), now,
        F.lit(True), F.col("jobs_seen"), F.col("jobs_new"),
    )
    return Synced(swept.drop("was_open"), report, rows)


class _Companies(NamedTuple):
    state: DataFrame
    ids: DataFrame
    fresh: DataFrame


def _companies(companies: DataFrame, named: DataFrame, seq: Column, now: Column) -> _Companies:
    """companies with a batch merged in, and change; the ids of all; the new ones."""
    key = ["ats_kind", "ats_slug"]
    new = merge.numbered(merge.new_keys(named, companies, key), last_id(companies))
    merged = merge.upsert_companies(companies.drop("id"), named, seq, now)
    ids = companies.select("id", *key).unionByName(new.select("id", *key))
    return _Companies(merged.join(ids, key), ids, new)


def merge_crawl(
    batch: DataFrame, companies: DataFrame, jobs: DataFrame, via: str, now: Column, start: int | None = None
) -> Crawled:
    """Merge the batch of a crawl (plans.pipelines): its companies, a log row for
    each posting, its jobs, and the row of the run. companies and jobs come back
    with change. A crawl sees no company's whole list, so it closes nothing."""
    seq = F.struct("source", "pos")
    batch = written(batch, "crawl")
    state = _companies(companies, batch, seq, now)
    ids = state.ids.withColumnRenamed("id", "company_id")
    rows = batch.join(ids, ["ats_kind", "ats_slug"])
    merged = _merged_jobs(jobs, rows, seq, now, start)
    each = batch.select(F.lit(1).alias("seen"), F.lit(0).alias("new")).unionByName(
        merged.where("change = 'new'").select(F.lit(0).alias("seen"), F.lit(1).alias("new"))
    )
    counted = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "new")])
    run = merge.run_row(counted, F.lit(via), now, now, F.lit(True), F.col("seen"), F.col("new"))
    return Crawled(state.state, merge.discoveries(batch, state.ids, F.lit(via), now), merged, run)


def failed_run(spark, source: str, started: Column, now: Column, error: str, http_status: int | None = None) -> DataFrame:
    """The run log's row of a run that ended with an error."""
    status = None if http_status is None else F.lit(http_status)
    none = F.lit(0)
    return merge.run_row(spark.range(1), F.lit(source), started, now, F.lit(False), none, none, status, F.lit(error))


def import_then_sync(
    lines: DataFrame, landed: DataFrame, companies: DataFrame, jobs: DataFrame, now: Column,
    via: str = "import:manual", start: int | None = None,
) -> Imported:
    """Import the companies that a list of URLs names (lines: value), then sync
    those that are new, and only those, from what has landed of them."""
    urls = written(url_list(lines).withColumn("ref", classify(F.col("url"))), "urls")
    named = urls.where("ref is not null").select(
        F.col("ref.kind").alias("ats_kind"), F.col("ref.slug").alias("ats_slug"),
        F.lit(None).cast("string").alias("name_hint"), F.col("url").alias("source_url"),
    )
    state = _companies(companies, named, F.col("source_url"), now)
    synced = sync(landed, state.fresh, jobs, now, start)
    report = reports.import_report(urls, companies)
    run = merge.run_row(report, F.lit(via), now, now, F.lit(True), F.col("items_seen"), F.col("companies_new"))
    log = merge.discoveries(named, state.ids, F.lit(via), now)
    return Imported(state.state, log, report, run, synced.jobs, synced.report)
