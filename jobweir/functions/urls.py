"""Classification of apply URLs, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"

#: Sub-domains that are no tenant's (fixed values).
NOT_TENANTS = (
    "www", "developers", "developer", "api", "docs", "doc", "support", "help", "blog", "store",
    "shop", "status", "marketing", "about", "info",
)
AUTH_WALL = ("/auth/login", "/auth/signup", "?signup=", "&signup=")
REF = "struct<kind:string,slug:string,external_id:string>"


def parts(url: Column) -> Column:
    """STRUCT<host, path, segs> of a URL with a host, else null. Parts are taken
    as written: no decoding, no IDNA."""
    host = F.lower(F.regexp_extract(url, _URL, 2))
    path = F.regexp_extract(url, _URL, 3)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(host != "", F.struct(host.alias("host"), path.alias("path"), segs.alias("segs")))


def after(segs: Column, word: str, steps: int = 1) -> Column:
    """The segment ``steps`` behind the first that equals word."""
    at = F.nullif(F.array_position(segs, word), F.lit(0)).cast("int")
    return F.try_element_at(segs, at + steps)


def is_locale(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z]{2}([-_][A-Za-z]{2})?$")


def auth_wall(url: Column) -> Column:
    low = F.lower(url)
    found = F.contains(low, F.lit(AUTH_WALL[0]))
    for x in AUTH_WALL[1:]:
        found = found | F.contains(low, F.lit(x))
    return found


def _ref(kind: str, slug: Column, external_id: Column | None = None) -> Column:
    id_ = F.lit(None).cast("string") if external_id is None else external_id
    return F.when(
        slug.isNotNull(), F.struct(F.lit(kind).alias("kind"), slug.alias("slug"), id_.alias("external_id"))
    )


def _under(host: Column, domain: str) -> Column:
    """Whether host is a sub-domain of domain."""
    return host.endswith("." + domain)


def _sub(host: Column, domain: str) -> Column:
    """The part of host before .domain; null if empty."""
    n = len(domain) + 1
    return F.nullif(F.left(host, F.char_length(host) - n), F.lit(""))


def from_parts(p: Column) -> Column:
    """STRUCT<kind, slug, external_id> by the first rule for the host, else null."""
    host, segs = p["host"], p["segs"]

    def seg(i: int) -> Column:
        return F.try_element_at(segs, F.lit(i))

    def has(*words: str) -> Column:
        return F.arrays_overlap(segs, F.array(*[F.lit(w) for w in words]))

    numbers = F.filter(segs, lambda s: s.rlike("^[0-9]+$"))
    names = F.split(host, r"\.")
    site = F.try_element_at(F.filter(segs, lambda s: ~is_locale(s)), F.lit(1))
    bamboo, recruitee = _sub(host, "bamboohr.com"), _sub(host, "recruitee.com")
    personio = F.coalesce(
        F.when(_under(host, "jobs.personio.com"), _sub(host, "jobs.personio.com")),
        _sub(host, "jobs.personio.de"),
    )
    tenant = F.when(
        (F.size(names) >= 4) & F.try_element_at(names, F.lit(2)).startswith("wd"),
        F.concat_ws("/", F.try_element_at(names, F.lit(1)), F.try_element_at(names, F.lit(2)), site),
    )
    return (
        F.when(host.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), _ref("greenhouse", seg(1), after(segs, "jobs")))
        .when(host == "jobs.ashbyhq.com", _ref("ashbyhq", seg(1), seg(2)))
        .when(host == "jobs.lever.co", _ref("lever", seg(1), seg(2)))
        .when(host.isin("apply.workable.com", "jobs.workable.com"), _ref("workable", seg(1), after(segs, "j")))
        .when(_under(host, "workable.com"), _ref("workable", _sub(host, "workable.com")))
        .when(host.isin("jobs.smartrecruiters.com", "careers.smartrecruiters.com"), _ref("smartrecruiters", seg(1), seg(2)))
        .when(
            _under(host, "bamboohr.com"),
            F.when(
                ~bamboo.isin(*NOT_TENANTS) & has("careers", "jobs"),
                _ref("bamboohr", bamboo, F.try_element_at(numbers, F.lit(-1))),
            ),
        )
        .when(
            _under(host, "recruitee.com"),
            F.when(~recruitee.isin(*NOT_TENANTS) & has("o", "careers"), _ref("recruitee", recruitee, after(segs, "o"))),
        )
        .when(_under(host, "jobs.personio.com") | _under(host, "jobs.personio.de"), _ref("personio", personio, seg(1)))
        .when(_under(host, "breezy.hr"), _ref("breezy", _sub(host, "breezy.hr"), after(segs, "p")))
        .when(_under(host, "teamtailor.com"), _ref("teamtailor", _sub(host, "teamtailor.com"), after(segs, "jobs")))
        .when(_under(host, "pinpointhq.com"), _ref("pinpoint", _sub(host, "pinpointhq.com"), after(segs, "postings")))
        .when(_under(host, "applytojob.com"), _ref("jazzhr", _sub(host, "applytojob.com"), after(segs, "apply")))
        .when(
            _under(host, "myworkdayjobs.com"),
            F.when(site.isNotNull(), _ref("workday", tenant, F.try_element_at(segs, F.lit(-1)))),
        )
        .when(host.isin("comeet.com", "www.comeet.com"), _ref("comeet", after(segs, "jobs"), after(segs, "jobs", 3)))
    )


def classify(url: Column) -> Column:
    """The platform, company and posting of an apply URL; null if none is known."""
    return F.get(F.transform(F.array(parts(url)), from_parts), 0)


def classify_or_other(url: Column) -> Column:
    """As classify, but other hosts are kind "other"; login pages are null."""

    def either(p: Column) -> Column:
        id_ = F.nullif(F.regexp_replace(p["path"], "^/+|/+$", ""), F.lit(""))
        return F.coalesce(from_parts(p), _ref("other", p["host"], id_))

    return F.when(~auth_wall(url), F.get(F.transform(F.array(parts(url)), either), 0))


def composite(slug: Column) -> Column:
    """STRUCT<tenant, region, site> of "tenant/wdN/site", else null."""
    p = F.split(slug, "/", 3)
    tenant, region, site = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    whole = (tenant != "") & region.startswith("wd") & (site != "")
    return F.when(whole, F.struct(tenant.alias("tenant"), region.alias("region"), site.alias("site")))


def id_or_url(external_id: Column, url: Column) -> Column:
    return F.coalesce(external_id, url)


def best_of(urls: Column) -> Column:
    """The first classifiable URL of an array, but a known platform's before others'.

    STRUCT<url, ref>, or null.
    """
    tried = F.transform(
        urls, lambda u, i: F.struct(i.alias("pos"), u.alias("url"), classify_or_other(u).alias("ref"))
    )
    known = F.filter(tried, lambda t: t["ref"].isNotNull())
    ranked = F.transform(
        known,
        lambda t: F.struct(
            (t["ref"]["kind"] == "other").alias("other"), t["pos"].alias("pos"), t["url"].alias("url"), t["ref"].alias("ref")
        ),
    )
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best["url"].alias("url"), best["ref"].alias("ref")))


def posting_url(kind: Column, slug: Column, external_id: Column) -> Column:
    """Where a platform shows a posting, for kinds with a known shape."""
    w = composite(slug)
    return (
        F.when(kind == "ashbyhq", F.concat(F.lit("https://jobs.ashbyhq.com/"), slug, F.lit("/"), external_id))
        .when(kind == "lever", F.concat(F.lit("https://jobs.lever.co/"), slug, F.lit("/"), external_id))
        .when(kind == "smartrecruiters", F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug, F.lit("/"), external_id))
        .when(kind == "bamboohr", F.concat(F.lit("https://"), slug, F.lit(".bamboohr.com/careers/"), external_id))
        .when(kind == "recruitee", F.concat(F.lit("https://"), slug, F.lit(".recruitee.com/o/"), external_id))
        .when(
            kind == "workday",
            F.concat(
                F.lit("https://"), w["tenant"], F.lit("."), w["region"],
                F.lit(".myworkdayjobs.com/en-US/"), w["site"], external_id,
            ),
        )
    )
