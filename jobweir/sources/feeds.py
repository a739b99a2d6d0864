"""Feeds, comment threads and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import entities, split_at, strip_tags, tag_payload, trimmed
from ..schemas import FEED

#: Tags of the structured feed (fixed values), and their column.
FEED_TAGS = {
    "title": "title", "link": "link", "clientCompany": "company", "category": "category",
    "description": "description", "jobLocation": "job_location", "workFlexibility": "work_flexibility",
    "externalApplicationLink": "external_application_link", "postedDate": "posted_date",
}
#: Where each engine's response keeps its hits, and the most it returns (fixed values).
ENGINES = {
    "brave": ("web struct<results:array<struct<url:string>>>", "web.results", 20),
    "google": ("items array<struct<link:string>>", "items", 10),
    "serper": ("organic array<struct<link:string>>", "organic", None),
    "tavily": ("results array<struct<url:string>>", "results", None),
    "exa": ("results array<struct<url:string>>", "results", None),
    "firecrawl": ("data array<struct<url:string>>", "data", None),
}
#: The title of the monthly thread (fixed value).
WHO_IS_HIRING = r"(?i)Ask HN:?\s*Who is hiring\?"


def items(df: DataFrame, parse, body: str = "body") -> DataFrame:
    """df with one row (pos, r) for each <item> of the body, r = parse(block). The
    parts are worked out before the rows are made, so filters on them do not work
    them out again."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    return df.select(*[c for c in df.columns if c != body], F.posexplode(F.transform(blocks, parse)).alias("pos", "r"))


def parse_rss(df: DataFrame, body: str = "body") -> DataFrame:
    """(..., pos, title, company, link) of items with a title and a link."""

    def tag(block: Column, name: str) -> Column:
        found = F.try_element_at(F.regexp_extract_all(block, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.lit(1))
        return trimmed(found)

    def parse(block: Column) -> Column:
        return F.struct(split_at(entities(tag(block, "title"))).alias("s"), tag(block, "link").alias("link"))

    rows = items(df, parse, body).where("r.s is not null and r.link is not null")
    return rows.select(
        *[c for c in rows.columns if c != "r"], F.col("r.s.role").alias("title"), F.col("r.s.company").alias("company"), "r.link"
    )


def parse_rss_cdata(df: DataFrame, body: str = "body") -> DataFrame:
    """Items of the structured feed with a title and a link, and raw_json."""

    def parse(block: Column) -> Column:
        found = {name: tag_payload(block, tag) for tag, name in FEED_TAGS.items()}
        found["description"] = strip_tags(found["description"])
        return F.struct(*[x.alias(name) for name, x in found.items()])

    rows = items(df, parse, body).where("r.title is not null and r.link is not null")
    return rows.select(*[c for c in rows.columns if c != "r"], "r.*", F.to_json("r").alias("raw_json"))


def parse_feed_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a JSON feed, each with its raw_json."""
    rows = F.from_json(body, f"array<struct<{', '.join(x.replace(' ', ':') for x in FEED.split(', ')) }>>")
    keep = [c for c in df.columns if c != body]
    out = df.select(*keep, F.posexplode(rows).alias("pos", "r"))
    return out.where("r.url is not null and r.title is not null").select(
        *keep, "pos", "r.*", F.to_json("r").alias("raw_json")
    )


def explode_thread(df: DataFrame, body: str = "body") -> DataFrame:
    """(..., pos, text) of the top-level comments that have a text."""
    children = F.from_json(body, "children array<struct<text:string>>")["children"]
    keep = [c for c in df.columns if c != body]
    return (
        df.select(*keep, F.posexplode(children).alias("pos", "c"))
        .select(*keep, "pos", F.col("c.text").alias("text"))
        .where("text is not null")
    )


def first_matching(
    df: DataFrame, group: list[str], order: str, text: str, pattern: str = WHO_IS_HIRING
) -> DataFrame:
    """The first row of each group, by order, whose text matches."""
    return (
        df.where(F.col(text).rlike(pattern))
        .groupBy(*group)
        .agg(F.min_by(F.struct(*[c for c in df.columns if c not in group]), order).alias("r"))
        .select(*group, "r.*")
    )


def search_hits(engine: str, landed: DataFrame, asked: int = 20) -> DataFrame:
    """(query, pos, url) from an engine's responses (query, body), at most as
    many as were asked for and the engine returns."""
    schema, path, most = ENGINES[engine]
    hits = F.from_json("body", schema)
    for p in path.split("."):
        hits = hits[p]
    n = min(asked, most or asked)
    field = "link" if engine in ("google", "serper") else "url"
    return (
        landed.select("query", F.posexplode(F.slice(hits, 1, n)).alias("pos", "h"))
        .select("query", "pos", F.col("h")[field].alias("url"))
        .where("url is not null")
    )
