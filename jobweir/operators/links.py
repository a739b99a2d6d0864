"""Links of pages: anchors, and which of them matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from ..functions.remote import SOCIAL, SOCIAL_AND_CHAT
from ..functions.urls import parts

_NOISE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
#: The rest of a start tag; a > in a quoted value does not end it. Loops are
#: bounded, as each turn takes room on the stack.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'){0,400}+>"""
_ANCHOR = r"(?is)<a\s" + _REST + r".*?</a>"
_OTHER = r"""(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?){0,200}?"""
_HREF = r"(?is)^<a" + _OTHER + r"""\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' other columns with (pos, href, text) of each <a href>, outside
    comments, scripts and styles; text is collapsed."""
    clean = F.regexp_replace(html, _NOISE, "")
    rows = pages.select(
        *[c for c in pages.columns if c != html],
        F.posexplode(F.regexp_extract_all(clean, F.lit(_ANCHOR), F.lit(0))).alias("pos", "a"),
    )
    rows = rows.where(F.col("a").rlike(_HREF))
    href = F.concat(*[F.regexp_extract("a", _HREF, i) for i in (1, 2, 3)])
    return rows.select(
        *[c for c in rows.columns if c not in ("a", "pos")],
        "pos",
        t.unescape(href, attribute=True).alias("href"),
        t.collapse(t.unescape(t.without_markup(F.col("a"), ""))).alias("text"),
    )


def _first_of_each(links: DataFrame, page: str, link: str, *columns: str) -> DataFrame:
    """Distinct links of a page with the pos and columns of their first place."""
    return links.groupBy(page, link).agg(
        F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in columns]
    )


def detail_links_hex(links: DataFrame, page: str = "page_id", prefix: str = "/jobs/") -> DataFrame:
    """(page, href, pos): links prefix + hexadecimal id of 12 digits or more."""
    return _first_of_each(links.where(F.col("href").rlike(f"^({prefix})+[0-9a-fA-F]{{12,}}$")), page, "href")


def detail_links_numeric(links: DataFrame, hosts: tuple[str, ...], page: str = "page_id") -> DataFrame:
    """(page, url, pos, title): links on a host whose last of two or more
    segments is a number; the title is the text or the segment before."""
    rows = links.withColumn("url", t.absolute(F.col("href"), hosts[0])).withColumn("p", parts(F.col("url")))
    segs = F.col("p.segs")
    rows = rows.where(
        F.col("p.host").isin(*hosts)
        & (F.size(segs) >= 2)
        & F.try_element_at(segs, F.lit(-1)).rlike("^[0-9]+$")
    )
    rows = rows.withColumn("title", t.title_or_slug(F.col("text"), F.try_element_at(segs, F.lit(-2))))
    return _first_of_each(rows, page, "url", "title")


def marker_links(links: DataFrame, marker: str, page: str = "page_id") -> DataFrame:
    """(page, href, pos, text): URLs with a marker, if their first place has a text."""
    rows = links.where(F.contains("href", F.lit(marker)) & parts(F.col("href")).isNotNull())
    return _first_of_each(rows, page, "href", "text").where("text <> ''")


def _external(own: str) -> Column:
    host = parts(F.col("href"))["host"]
    return host.isNotNull() & ~host.endswith(own)


def _best(links: DataFrame, page: str, tier: Column) -> DataFrame:
    """(page, href): of each page the first link of the lowest tier that is not null."""
    return (
        links.withColumn("_tier", tier)
        .where("_tier is not null")
        .groupBy(page)
        .agg(F.min_by("href", F.struct("_tier", "pos")).alias("href"))
    )


def apply_link_marker(links: DataFrame, own: str, marker: str, page: str = "page_id") -> DataFrame:
    """The first external link with the marker, else the first that is not social."""
    host = parts(F.col("href"))["host"]
    tier = F.when(_external(own), F.when(F.contains("href", F.lit(marker)), 0).when(~host.isin(*SOCIAL), 1))
    return _best(links, page, tier)


def apply_link_text(links: DataFrame, own: str, marker: str, page: str = "page_id") -> DataFrame:
    """The first external link with the marker, else the first called apply."""
    says = F.lower("text").isin("apply", "apply now")
    return _best(links, page, F.when(_external(own), F.when(F.contains("href", F.lit(marker)), 0).when(says, 1)))


def first_outbound(links: DataFrame, own: str, page: str = "page_id") -> DataFrame:
    host = parts(F.col("href"))["host"]
    return _best(links, page, F.when(_external(own) & ~host.isin(*SOCIAL_AND_CHAT), 0))


def preferred(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def page_title(html: Column, url: Column) -> Column:
    """Text of the first h1, or of title if there is no h1; the URL if empty."""
    h1 = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    chosen = F.when(html.rlike(r"(?is)<h1\b[^>]*>.*?</h1>"), h1).otherwise(title)
    found = t.trimmed(t.entities(F.regexp_replace(chosen, t.TAG, "")))
    return F.coalesce(F.nullif(found, F.lit("")), url)
