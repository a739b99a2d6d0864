"""Platforms' posting lists -> the posting schema. Registry: NORMALISERS."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import remote
from ..functions.text import city_state, first_name, html_to_text, joined_html, millis_text
from ..functions.urls import composite, posting_url
from ..schemas import ENTRIES
from .landed import entries, entry_of, listed, once

#: Fields of a posting that a platform's entry gives.
NAMES = ("external_id", "title", "location", "department", "apply_url", "description", "remote", "posted_at")


class Platform(NamedTuple):
    """What an entry needs to be a posting, and the posting's fields, of columns
    got by the names of an entry's fields. A description in mark-up is made text
    afterwards, so that a plan holds those expressions once for all platforms."""

    required: tuple[str, ...]
    fields: Callable[[Callable[[str], Column]], dict[str, Column]]
    markup: bool = False
    wanted: Column | None = None


def greenhouse(e) -> dict[str, Column]:
    return dict(
        external_id=e("id"),
        title=e("title"),
        location=e("location.name"),
        department=first_name(e("departments"), "name"),
        apply_url=e("absolute_url"),
        description=e("content"),
        remote=remote.from_offices(e("location.name"), e("offices")),
        posted_at=e("updated_at"),
    )


def ashby(e) -> dict[str, Column]:
    return dict(
        external_id=e("id"),
        title=e("title"),
        location=e("locationName"),
        department=e("departmentName"),
        apply_url=F.coalesce(e("jobUrl"), posting_url(F.lit("ashbyhq"), F.col("slug"), e("id"))),
        description=e("descriptionPlain"),
        remote=e("isRemote"),
        posted_at=e("publishedAt"),
    )


def lever(e) -> dict[str, Column]:
    return dict(
        external_id=e("id"),
        title=e("text"),
        location=e("categories.location"),
        department=e("categories.team"),
        apply_url=F.coalesce(e("hostedUrl"), posting_url(F.lit("lever"), F.col("slug"), e("id"))),
        description=e("descriptionPlain"),
        remote=remote.exactly(e("workplaceType")),
        posted_at=millis_text(e("createdAt")),
    )


def smartrecruiters(e) -> dict[str, Column]:
    return dict(
        external_id=e("id"),
        title=e("name"),
        location=e("location.fullLocation"),
        department=e("department.label"),
        apply_url=posting_url(F.lit("smartrecruiters"), F.col("slug"), e("id")),
        remote=e("location.remote"),
        posted_at=e("releasedDate"),
    )


def bamboohr(e) -> dict[str, Column]:
    place = city_state(e("location.city"), e("location.state"))
    return dict(
        external_id=e("id"),
        title=e("jobOpeningName"),
        location=place,
        department=e("departmentLabel"),
        apply_url=posting_url(F.lit("bamboohr"), F.col("slug"), e("id")),
        remote=remote.from_flag_or_place(e("isRemote"), place, e("locationType")),
    )


def recruitee(e) -> dict[str, Column]:
    return dict(
        external_id=e("id"),
        title=e("title"),
        location=e("location"),
        department=e("department"),
        apply_url=F.coalesce(e("careers_url"), posting_url(F.lit("recruitee"), F.col("slug"), e("id"))),
        description=joined_html(e("description"), e("requirements")),
        remote=e("remote"),
        posted_at=e("published_at"),
    )


def workday(e) -> dict[str, Column]:
    code = F.try_element_at(e("bulletFields"), F.lit(1))
    return dict(
        external_id=F.coalesce(code, F.substring_index(e("externalPath"), "/", -1)),
        title=e("title"),
        location=e("locationsText"),
        apply_url=posting_url(F.lit("workday"), F.col("slug"), e("externalPath")),
        remote=remote.from_location(e("locationsText")),
        posted_at=e("postedOn"),
    )


def _platforms() -> dict[str, Platform]:
    return {
        "greenhouse": Platform(("id", "title", "absolute_url"), greenhouse, markup=True),
        "ashbyhq": Platform(("id", "title"), ashby),
        "lever": Platform(("id", "text"), lever),
        "smartrecruiters": Platform(("id", "name"), smartrecruiters),
        "bamboohr": Platform(("id", "jobOpeningName"), bamboohr),
        "recruitee": Platform(("id", "title"), recruitee, markup=True),
        # companies whose slug is not tenant/wdN/site give no postings
        "workday": Platform(("title", "externalPath"), workday, wanted=composite(F.col("slug")).isNotNull()),
    }


def _field(name: str, of: dict[str, Column]) -> Column:
    return of.get(name, F.lit(None)).cast("boolean" if name == "remote" else "string")


def _one(landed: DataFrame, kind: str) -> DataFrame:
    """Entries of one kind as postings; those without a required field are dropped."""
    of = _platforms()[kind]
    rows = entries(landed if of.wanted is None else landed.where(of.wanted), kind)
    for name in of.required:
        rows = rows.where(F.col(f"e.{name}").isNotNull())
    fields = of.fields(lambda name: F.col(f"e.{name}"))
    if of.markup:
        fields["description"] = html_to_text(fields["description"])
    return rows.select(
        F.lit(kind).alias("kind"), "slug", "fetched_at", "page_offset", "pos",
        *[_field(n, fields).alias(n) for n in NAMES], "raw_json",
    )


#: Postings of one kind of the landed responses.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {k: partial(_one, kind=k) for k in ENTRIES}


def normalise(landed: DataFrame, kinds=None) -> DataFrame:
    """Postings of all kinds (or some) that have a normaliser, in one pass: each
    entry is read by the schema of its kind."""
    found = {k: p for k, p in _platforms().items() if kinds is None or k in kinds}
    kind = F.col("kind")
    rows = landed.where(kind.isin(*found)).select(
        "kind", "slug", "fetched_at", "page_offset", F.posexplode(listed()).alias("pos", "entry")
    )
    rows = rows.select("*", once(F.struct(*[F.when(kind == k, entry_of(k)).alias(k) for k in found])).alias("e"))
    good = []
    for k, p in found.items():
        needs = [F.col(f"e.{k}._corrupt").isNull(), *[F.col(f"e.{k}.{n}").isNotNull() for n in p.required]]
        needs += [] if p.wanted is None else [p.wanted]
        good.append((kind == k) & reduce(lambda a, b: a & b, needs))
    rows = rows.where(reduce(lambda a, b: a | b, good))
    fields = {k: p.fields(lambda name, k=k: F.col(f"e.{k}.{name}")) for k, p in found.items()}

    def chosen(name: str) -> Column:
        out = F
        for k, of in fields.items():
            if name in of:
                out = out.when(kind == k, _field(name, of))
        return F.lit(None).cast("string") if out is F else out

    rows = rows.select(
        "kind", "slug", "fetched_at", "page_offset", "pos", *[chosen(n).alias(n) for n in NAMES],
        F.to_json(F.try_parse_json("entry")).alias("raw_json"),
    )
    markup = [k for k, p in found.items() if p.markup]
    if not markup:
        return rows
    text = F.when(kind.isin(*markup), html_to_text(F.col("description"))).otherwise(F.col("description"))
    return rows.withColumn("description", text)
