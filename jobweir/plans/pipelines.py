"""From landed sources to merge batches.

A batch has, for each row: ats_kind, ats_slug, external_id, name_hint,
source_url, title, location, department, apply_url, description, remote,
posted_at, raw_json, and (source, pos) for its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import remote, text as t
from ..functions.urls import best_of, classify_or_other, id_or_url
from ..operators import links
from ..operators.discover import kind_matched, plan_hits
from ..sources import feeds
from ..sources.landed import resolve_redirects

FIELDS = (
    "name_hint", "source_url", "title", "location", "department", "apply_url", "description",
    "remote", "posted_at", "raw_json",
)


def batch(rows: DataFrame, order: list[str], ref: Column | None = None, **fields: Column) -> DataFrame:
    """Rows whose apply URL names a company, in the batch schema."""
    apply_url = fields["apply_url"]
    ref = classify_or_other(apply_url) if ref is None else ref
    # as rows of their own: the filter below would work the reference out again
    rows = rows.select("*", F.explode(F.array(ref)).alias("_ref"))
    default = {"raw_json": F.lit("{}"), "remote": F.lit(None).cast("boolean")}
    return rows.where("_ref is not null").select(
        *order,
        F.col("_ref.kind").alias("ats_kind"),
        F.col("_ref.slug").alias("ats_slug"),
        id_or_url(F.col("_ref.external_id"), apply_url).alias("external_id"),
        *[fields.get(f, default.get(f, F.lit(None).cast("string"))).alias(f) for f in FIELDS],
    )


def rss_with_pages(feed: DataFrame, pages: DataFrame, own: str, marker: str) -> DataFrame:
    """Feed items (source, body) and their landed pages (url, html)."""
    items = feeds.parse_rss(feed)
    found = links.apply_link_marker(links.anchors(pages.select("url", "html")), own, marker, page="url")
    rows = items.join(found.withColumnRenamed("url", "link"), "link")
    return batch(
        rows, ["source", "pos"], name_hint=F.col("company"), source_url=F.col("link"),
        title=F.col("title"), apply_url=F.col("href"),
    )


def structured_rss(feed: DataFrame) -> DataFrame:
    rows = feeds.parse_rss_cdata(feed)
    return batch(
        rows, ["source", "pos"], name_hint=F.col("company"), source_url=F.col("link"),
        title=F.col("title"), location=F.col("job_location"), department=F.col("category"),
        apply_url=links.preferred(F.col("external_application_link"), F.col("link")),
        description=F.col("description"), remote=remote.exactly(F.col("work_flexibility")),
        posted_at=F.col("posted_date"), raw_json=F.col("raw_json"),
    )


def thread(threads: DataFrame) -> DataFrame:
    """Top-level comments of landed threads (source, body)."""
    rows = feeds.explode_thread(threads).withColumn("best", best_of(t.hrefs(F.col("text"))))
    rows = rows.where("best is not null").withColumn("title", t.comment_title(F.col("text")))
    return batch(
        rows, ["source", "pos"], F.col("best.ref"), name_hint=t.company_hint(F.col("title")),
        source_url=F.col("best.url"), title=F.col("title"), apply_url=F.col("best.url"),
    )


def listing_with_details(listing: DataFrame, pages: DataFrame, host: str) -> DataFrame:
    """Listings (source, html) and landed detail pages (url, html)."""
    found = links.detail_links_hex(links.anchors(listing), page="source")
    found = found.withColumn("url", F.concat(F.lit(f"https://{host}"), F.col("href"))).drop("href")
    out = links.first_outbound(links.anchors(pages.select("url", "html")), host, page="url")
    titles = pages.select("url", links.page_title(F.col("html"), F.col("url")).alias("title"))
    rows = found.join(out, "url").join(titles, "url")
    return batch(
        rows, ["source", "pos"], source_url=F.col("url"), title=F.col("title"), apply_url=F.col("href")
    )


def listing_with_button(
    listing: DataFrame, pages: DataFrame, hosts: tuple[str, ...], own: str, marker: str
) -> DataFrame:
    found = links.detail_links_numeric(links.anchors(listing), hosts, page="source")
    out = links.apply_link_text(links.anchors(pages.select("url", "html")), own, marker, page="url")
    rows = found.join(out, "url")
    return batch(
        rows, ["source", "pos"], source_url=F.col("url"), title=F.col("title"), apply_url=F.col("href")
    )


def json_feed(feed: DataFrame, redirects: DataFrame, feed_url: str) -> DataFrame:
    rows = resolve_redirects(feeds.parse_feed_json(feed), redirects)
    return batch(
        rows, ["source", "pos"], name_hint=F.col("company_name"), source_url=F.lit(feed_url),
        title=F.col("title"), location=F.nullif(F.col("location"), F.lit("")),
        department=F.col("category_name"), apply_url=F.col("final_url"),
        description=t.strip_tags(F.col("description")),
        remote=remote.from_location_or_tags(F.col("location"), F.col("tags")),
        posted_at=F.col("pub_date"), raw_json=F.col("raw_json"),
    )


def marker_listing(listing: DataFrame, marker: str) -> DataFrame:
    found = links.marker_links(links.anchors(listing), marker, page="source")
    url = F.col("href")
    return batch(
        found, ["source", "pos"], source_url=url, title=F.col("text"), apply_url=url,
        remote=F.lit(True), raw_json=F.to_json(F.struct(url.alias("apply_url"))),
    )


def cleaned(postings: DataFrame) -> DataFrame:
    """Postings of a sync as they are merged: texts trimmed, empty is null."""
    out = postings.withColumn("title", t.trimmed(F.col("title")))
    return out.withColumns({c: t.trim_null(F.col(c)) for c in ("location", "department", "description")})


def discovered(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """Companies of a discovery run: (ats_kind, ats_slug, name_hint, source_url)."""
    rows = kind_matched(plan_hits(plan, hits).where("url is not null"))
    return rows.select(
        F.col("ref.kind").alias("ats_kind"),
        F.col("ref.slug").alias("ats_slug"),
        F.lit(None).cast("string").alias("name_hint"),
        F.col("url").alias("source_url"),
    )
