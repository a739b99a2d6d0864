"""Queries over the test tables, each with SQL that gives the same rows.

The test tables hold no postings, so inputs are derived from them by SQL that
Spark and DuckDB both run (VIEWS); a query applies operators to these inputs,
and its oracle says the same in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import dates, urls
from .operators import discover, listing, merge

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
NOW = 1_735_689_600  # 2025-01-01
KINDS7 = ("greenhouse", "ashbyhq", "lever", "smartrecruiters", "bamboohr", "recruitee", "workday")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _cases(of: str, values, start: int = 0) -> str:
    rows = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values, start))
    return f"CASE {of} {rows} END"


def _quoted(values) -> list[str]:
    return ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]


#: {k} stands for a number that varies by row.
URLS = (
    "https://boards.greenhouse.io/acme{k}/jobs/{k}", "https://job-boards.greenhouse.io/acme/jobs",
    "https://boards.greenhouse.io/", "https://jobs.ashbyhq.com/Parity{k}/abc-def", "https://jobs.lever.co/demo/u{k}",
    "https://jobs.lever.co/demo{k}", "https://apply.workable.com/circle/j/ABC{k}", "https://jobs.workable.com/x/{k}",
    "https://acme{k}.workable.com/", "https://www.workable.com/a", "https://jobs.smartrecruiters.com/Acme/{k}",
    "https://careers.smartrecruiters.com/Acme{k}", "https://www.bamboohr.com/careers/team",
    "https://developers.bamboohr.com/jobs/anything", "https://solo{k}.bamboohr.com/about",
    "https://solo.bamboohr.com/jobs/view.php", "https://solo.bamboohr.com/careers/{k}/x/77",
    "https://www.recruitee.com/o/features", "https://exeon{k}.recruitee.com/o/senior-dev", "https://exeon.recruitee.com/careers",
    "https://firm.jobs.personio.com/{k}", "https://firm{k}.jobs.personio.de/", "https://co{k}.breezy.hr/p/{k}-dev",
    "https://co.teamtailor.com/jobs/{k}", "https://co{k}.pinpointhq.com/en/postings/{k}", "https://co.applytojob.com/apply/x{k}/Dev",
    "https://nvidia.wd5.myworkdayjobs.com/en-US/NVIDIAExternalCareerSite/job/Israel/Engineer_JR{k}",
    "https://sales{k}.wd1.myworkdayjobs.com/External_Career_Site/job/CA/Eng_JR{k}", "https://nvidia.wd5.myworkdayjobs.com/",
    "https://nvidia.xx5.myworkdayjobs.com/Site/job", "https://nvidia.wd5.myworkdayjobs.com/fr_FR",
    "https://www.comeet.com/jobs/acme/1{k}.0/dev/A.{k}", "https://comeet.com/about/{k}", "https://example.com/careers/{k}",
    "https://jobs.solana.com/companies/ondo/jobs/{k}-x", "mailto:hr{k}@acme.com",
    "https://network.bondex.app/auth/login?signup=web3.career&n={k}", "  HTTPS://user@BOARDS.Greenhouse.io:443/Up{k}/jobs/9?x=1#y",
    "no url {k}", "https://acme.example/a b/{k}?signup=1", "", None,
)


def _url(of: str) -> str:
    k = f"' || CAST({of} AS STRING) || '"
    values = [v if v == "NULL" else v.replace("{k}", k) for v in _quoted(URLS)]
    return _cases(f"{of} % {len(URLS)}", values)


VIEWS = {
    "v_co": f"""
SELECT c_custkey AS id, c_name AS name, {_cases('c_custkey % 7', _quoted(KINDS7))} AS ats_kind,
       lower(replace(c_name, '#', '-')) AS ats_slug,
       '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS last_seen
FROM customer""",
    "v_job": """
SELECT o_orderkey AS id, o_custkey AS company_id, 'Role ' || o_orderpriority || ' ' || CAST(o_orderkey % 97 AS STRING) AS title,
       CASE o_orderkey % 4 WHEN 0 THEN 'Berlin, Germany' WHEN 1 THEN 'USA Remote' WHEN 2 THEN 'Zürich' END AS location,
       CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote,
       CASE WHEN o_orderkey % 5 <> 1 THEN 'Dept ' || CAST(o_orderkey % 6 AS STRING) END AS department,
       'https://jobs.example/' || CAST(o_orderkey AS STRING) AS apply_url,
       CASE o_orderkey % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'dismissed' ELSE 'new' END AS status,
       CASE o_orderkey % 8
         WHEN 0 THEN '2024-0' || CAST(1 + o_orderkey % 9 AS STRING) || '-1' || CAST(o_orderkey % 10 AS STRING) || 'T06:30:00Z'
         WHEN 1 THEN '2024-1' || CAST(o_orderkey % 3 AS STRING) || '-15 12:00:00 UTC'
         WHEN 2 THEN 'Posted ' || CAST(o_orderkey % 30 AS STRING) || ' Days Ago' WHEN 3 THEN 'Posted 30+ Days Ago'
         WHEN 4 THEN 'Posted Today' WHEN 5 THEN 'Posted Yesterday' WHEN 6 THEN 'Jun 02, 2026' END AS posted_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at, o_orderdate AS last_seen
FROM orders""",
    "v_url": f"SELECT o_orderkey AS id, {_url('o_orderkey')} AS url FROM orders",
    "v_text": """
SELECT doc_id AS id, text AS description, source AS location, lang AS department,
       split_part(text, chr(10), 1) AS title FROM documents""",
    "v_html": """
SELECT page_id AS id, html, url,
       '<p>Acme ' || CAST(page_id AS STRING) || ' | SWE &amp;lt; Remote</p> <b>x</b>&nbsp;&amp; &quot;y&quot; &#39;z&#39; &apos;' || ' <!-- c --> <a href="https:&#x2F;&#x2F;boards.greenhouse.io&#x2F;acme&#x2F;jobs&#x2F;' || CAST(page_id AS STRING) || '">go</a>' AS bit
FROM pages""",
    # a posting key for each (part, supplier class); a row of lineitem is one sighting
    "v_snap": """
SELECT l_partkey * 10 + l_suppkey % 10 AS k, min(l_orderkey) AS company_id, max('T' || CAST(l_orderkey AS STRING)) AS title,
       max(CASE WHEN l_linenumber > 3 THEN 'D' || CAST(l_orderkey AS STRING) END) AS description,
       min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
       max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS closed_at,
       CASE WHEN min(l_linenumber) % 2 = 0 THEN 'applied' ELSE 'new' END AS status
FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY l_partkey * 10 + l_suppkey % 10""",
    "v_batch": """
SELECT DISTINCT l_partkey * 10 + l_suppkey % 10 AS k, l_orderkey AS company_id, 'T' || CAST(l_orderkey AS STRING) AS title,
       CASE WHEN l_linenumber > 3 THEN 'D' || CAST(l_orderkey AS STRING) END AS description,
       l_shipdate AS ts, l_orderkey AS o, l_linenumber AS n
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00'""",
    "v_run": """
SELECT event_id AS run_id, event_type AS source, ts AS started_at, event_id % 7 <> 0 AS ok,
       user_id AS items_seen, user_id % 3 AS items_new FROM events""",
}


#: Tables of few bytes a row, one row group of which may hold all their rows: the
#: views make long bodies of them, so their rows are dealt to all tasks first.
NARROW = ("customer", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; the tables are read with only the columns it uses."""
    for table in TABLES:
        if table in VIEWS[name]:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if table in NARROW:
                rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, rows.columns[0])
            rows.createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "


def query(name: str, views: tuple[str, ...], sql: str):
    """Register a query that gets its views, and its SQL over them."""

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(*[view(spark, sf_dir, v) for v in views])
        if sql:
            body, start = sql.lstrip(), "WITH "
            if body.startswith("WITH RECURSIVE "):
                body, start = "WITH " + body[len("WITH RECURSIVE ") :], "WITH RECURSIVE "
            head = start + _with(*views)[len("WITH ") :]
            ORACLES[name] = head + (", " + body[5:] if body.startswith("WITH ") else body)
        return make

    return add


def _positioned(df: DataFrame, *order: Column) -> DataFrame:
    """A page of a listing with its places, from 1."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


# --- listings ---------------------------------------------------------------

_SECONDS = """CASE
  WHEN regexp_matches(posted_at, '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ$') THEN epoch(strptime(posted_at, '%Y-%m-%dT%H:%M:%SZ'))
  WHEN regexp_matches(posted_at, ' UTC$') THEN epoch(strptime(posted_at, '%Y-%m-%d %H:%M:%S UTC')) END"""
_AGE = f"""CASE WHEN posted_at IS NULL THEN '?'
  WHEN {_SECONDS} IS NOT NULL THEN CAST(greatest(0, floor(({NOW} - {_SECONDS}) / 86400))::BIGINT AS STRING) || 'd'
  WHEN posted_at = 'Posted Today' THEN '0d' WHEN posted_at = 'Posted Yesterday' THEN '1d'
  WHEN posted_at = 'Posted 30+ Days Ago' THEN '>30d'
  WHEN posted_at LIKE 'Posted % Days Ago' THEN replace(replace(posted_at, 'Posted ', ''), ' Days Ago', '') || 'd'
  ELSE posted_at END"""
_TAGS = """concat_ws(' ', CASE WHEN remote THEN '[remote]' END, CASE WHEN status = 'applied' THEN '[applied]' END,
  CASE WHEN status = 'dismissed' THEN '[dismissed]' END)"""


def _listing_sql(where: str, tail: str = "", pos: str = "") -> str:
    return f"""
SELECT j.id, c.name AS company, title, coalesce(location, '') AS location, apply_url, posted_at, j.last_seen,
       {_AGE} AS age, {_TAGS} AS tags{pos}
FROM v_job j JOIN v_co c ON j.company_id = c.id WHERE closed_at IS NULL AND {where} {tail}"""


def _list(**options):
    return lambda jobs, companies: listing.list_jobs(jobs, companies, F.lit(NOW), **options)


query("list_jobs", ("v_job", "v_co"), _listing_sql("status <> 'dismissed'"))(_list())
query("list_jobs_remote", ("v_job", "v_co"), _listing_sql("status <> 'dismissed' AND remote"))(_list(remote=True))
query("list_jobs_applied", ("v_job", "v_co"), _listing_sql("status = 'applied'"))(_list(show="applied"))
query("list_jobs_all", ("v_job", "v_co"), _listing_sql("TRUE"))(_list(show="all"))

_ORDER = "posted_at IS NULL, posted_at, j.last_seen DESC, j.id"


@query(
    "list_jobs_page",
    ("v_job", "v_co"),
    _listing_sql(
        "status <> 'dismissed'", "QUALIFY pos BETWEEN 101 AND 150", f", row_number() OVER (ORDER BY {_ORDER}) AS pos"
    ),
)
def list_jobs_page(jobs, companies):
    rows = listing.list_jobs(jobs, companies, F.lit(NOW), limit=50, start=100)
    out = _positioned(rows, F.col("posted_at").asc_nulls_last(), F.col("last_seen").desc(), F.col("id"))
    return out.withColumn("pos", F.col("pos") + 100)


@query(
    "by_company",
    ("v_job", "v_co"),
    """
SELECT c.id, c.name, ats_kind, ats_slug, j.id AS job_id, j.title, coalesce(location, '') AS location,
       row_number() OVER (PARTITION BY c.id ORDER BY lower(j.title), j.id) AS pos
FROM v_co c JOIN v_job j ON j.company_id = c.id WHERE closed_at IS NULL""",
)
def by_company(jobs, companies):
    nested = listing.by_company(jobs, companies)
    return nested.select("id", "name", "ats_kind", "ats_slug", F.posexplode("jobs").alias("pos", "j")).select(
        "id", "name", "ats_kind", "ats_slug", F.col("j.id").alias("job_id"), "j.title", "j.location",
        (F.col("pos") + 1).alias("pos"),
    )


query("list_companies", ("v_co",), "SELECT ats_kind, ats_slug, name, last_seen, id FROM v_co")(listing.list_companies)
query(
    "open_recent", ("v_job", "v_co"),
    """SELECT j.id, c.name AS company, title, coalesce(location, '') AS location, apply_url, j.last_seen
FROM v_job j JOIN v_co c ON j.company_id = c.id WHERE closed_at IS NULL""",
)(listing.open_recent)
query("kind_slugs", ("v_co",), "SELECT id, name, ats_slug FROM v_co WHERE ats_kind = 'lever'")(
    lambda c: listing.of_kind(c, "lever")
)
query(
    "find_slug", ("v_co",),
    "SELECT * FROM v_co WHERE ats_slug = (SELECT min(ats_slug) FROM v_co WHERE ats_kind = 'lever') AND ats_kind = 'lever'",
)(
    lambda c: c.join(
        c.where("ats_kind = 'lever'").agg(F.min("ats_slug").alias("ats_slug")), "ats_slug"
    ).where("ats_kind = 'lever'").select(*c.columns)
)
query(
    "totals", ("v_job", "v_co"),
    """SELECT (SELECT count(*) FROM v_co) AS companies, (SELECT count(*) FROM v_job WHERE closed_at IS NULL) AS open_jobs""",
)(listing.totals)
query("orphans", ("v_job", "v_co"), "SELECT id FROM v_job WHERE company_id NOT IN (SELECT id FROM v_co WHERE id % 3 <> 0)")(
    lambda jobs, co: merge.orphans(jobs, co.where("id % 3 <> 0")).select("id")
)
query(
    "age_days", ("v_job",),
    f"""SELECT id, CAST(CASE WHEN {_SECONDS} IS NOT NULL THEN greatest(0, floor(({NOW} - {_SECONDS}) / 86400))
  WHEN posted_at = 'Posted Today' THEN 0 WHEN posted_at = 'Posted Yesterday' THEN 1
  WHEN posted_at = 'Posted 30+ Days Ago' THEN 30
  WHEN posted_at LIKE 'Posted % Days Ago' THEN CAST(replace(replace(posted_at, 'Posted ', ''), ' Days Ago', '') AS INT)
  END AS INT) AS age_days FROM v_job""",
)(lambda j: j.select("id", dates.age_days(F.col("posted_at"), F.lit(NOW)).alias("age_days")))

_MS = "(CAST(run_id AS BIGINT) * 7919 * (1 + run_id % 5 * 37)) % 400000000"
query(
    "run_duration", ("v_run",),
    f"""WITH m AS (SELECT run_id, {_MS} AS ms FROM v_run), s AS (SELECT *, ms // 1000 AS s FROM m)
SELECT run_id, CASE WHEN ms < 1000 THEN CAST(ms AS STRING) || 'ms' WHEN s < 60 THEN CAST(s AS STRING) || 's'
  WHEN s < 3600 THEN CAST(s // 60 AS STRING) || 'min ' || CAST(s % 60 AS STRING) || 's'
  WHEN s < 86400 THEN CAST(s // 3600 AS STRING) || 'h ' || CAST(s % 3600 // 60 AS STRING) || 'min ' || CAST(s % 60 AS STRING) || 's'
  ELSE CAST(s // 86400 AS STRING) || 'd ' || CAST(s % 86400 // 3600 AS STRING) || 'h ' || CAST(s % 3600 // 60 AS STRING) || 'min'
  END AS took FROM s""",
)(lambda r: r.select("run_id", dates.duration_text(F.expr(_MS)).alias("took")))

# --- URLs -------------------------------------------------------------------

_PARTS = r"""WITH p AS (
  SELECT id, url, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 2)) AS host,
         regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 3) AS path
  FROM v_url
), s AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS g,
         split_part(host, '.', 1) AS sub, string_split(host, '.') AS hs FROM p
), r AS (
  SELECT *, list_filter(g, lambda x: NOT regexp_full_match(x, '[A-Za-z]{2}([-_][A-Za-z]{2})?'))[1] AS site,
         list_filter(g, lambda x: regexp_full_match(x, '[0-9]+'))[-1] AS num FROM s
), k AS (
  SELECT *, CASE
    WHEN host IN ('boards.greenhouse.io', 'job-boards.greenhouse.io') THEN ['greenhouse', g[1], CASE WHEN list_position(g, 'jobs') > 0 THEN g[list_position(g, 'jobs') + 1] END]
    WHEN host = 'jobs.ashbyhq.com' THEN ['ashbyhq', g[1], g[2]]
    WHEN host = 'jobs.lever.co' THEN ['lever', g[1], g[2]]
    WHEN host IN ('apply.workable.com', 'jobs.workable.com') THEN ['workable', g[1], CASE WHEN list_position(g, 'j') > 0 THEN g[list_position(g, 'j') + 1] END]
    WHEN host LIKE '%.workable.com' THEN ['workable', replace(host, '.workable.com', ''), NULL]
    WHEN host IN ('jobs.smartrecruiters.com', 'careers.smartrecruiters.com') THEN ['smartrecruiters', g[1], g[2]]
    WHEN host LIKE '%.bamboohr.com' THEN CASE WHEN sub NOT IN ('www', 'developers') AND (list_contains(g, 'careers') OR list_contains(g, 'jobs')) THEN ['bamboohr', sub, num] END
    WHEN host LIKE '%.recruitee.com' THEN CASE WHEN sub <> 'www' AND (list_contains(g, 'o') OR list_contains(g, 'careers')) THEN ['recruitee', sub, CASE WHEN list_position(g, 'o') > 0 THEN g[list_position(g, 'o') + 1] END] END
    WHEN host LIKE '%.jobs.personio.com' OR host LIKE '%.jobs.personio.de' THEN ['personio', sub, g[1]]
    WHEN host LIKE '%.breezy.hr' THEN ['breezy', sub, g[list_position(g, 'p') + 1]]
    WHEN host LIKE '%.teamtailor.com' THEN ['teamtailor', sub, g[list_position(g, 'jobs') + 1]]
    WHEN host LIKE '%.pinpointhq.com' THEN ['pinpoint', sub, g[list_position(g, 'postings') + 1]]
    WHEN host LIKE '%.applytojob.com' THEN ['jazzhr', sub, g[list_position(g, 'apply') + 1]]
    WHEN host LIKE '%.myworkdayjobs.com' AND hs[2] LIKE 'wd%' AND site IS NOT NULL THEN ['workday', hs[1] || '/' || hs[2] || '/' || site, g[-1]]
    WHEN host IN ('comeet.com', 'www.comeet.com') AND list_position(g, 'jobs') > 0 THEN ['comeet', g[list_position(g, 'jobs') + 1], g[list_position(g, 'jobs') + 3]]
    END AS c FROM r
), f AS (SELECT *, CASE WHEN c[2] IS NOT NULL THEN c END AS ref FROM k), o AS (
  SELECT *, CASE WHEN regexp_matches(lower(url), '/auth/login|/auth/signup|[?&]signup=') THEN NULL WHEN ref IS NOT NULL THEN ref
    WHEN host <> '' THEN ['other', host, nullif(trim(path, '/'), '')] END AS any_ref FROM f
) """


def _ref(make):
    return lambda v: v.select("id", make(F.col("url")).alias("r")).select("id", "r.kind", "r.slug", "r.external_id")


query("classify_strict", ("v_url",), _PARTS + "SELECT id, ref[1] AS kind, ref[2] AS slug, ref[3] AS external_id FROM f")(
    _ref(urls.classify)
)
query("classify_other", ("v_url",), _PARTS + "SELECT id, any_ref[1] AS kind, any_ref[2] AS slug, any_ref[3] AS external_id FROM o")(
    _ref(urls.classify_or_other)
)
query("url_parts", ("v_url",), _PARTS + "SELECT id, nullif(host, '') AS host, CASE WHEN host <> '' THEN path END AS path, CASE WHEN host <> '' THEN len(g)::INT END AS n_segs FROM s")(
    lambda v: v.select("id", urls.parts(F.col("url")).alias("p")).select(
        "id", "p.host", "p.path", F.when(F.col("p").isNotNull(), F.size("p.segs")).alias("n_segs")
    )
)
query("auth_wall", ("v_url",), "SELECT id, regexp_matches(lower(url), '/auth/login|/auth/signup|[?&]signup=') AS wall FROM v_url")(
    lambda v: v.select("id", urls.auth_wall(F.col("url")).alias("wall"))
)
query("id_fallback", ("v_url",), _PARTS + "SELECT id, coalesce(any_ref[3], url) AS external_id FROM o")(
    lambda v: v.select("id", urls.id_or_url(urls.classify_or_other(F.col("url"))["external_id"], F.col("url")).alias("external_id"))
)
query(
    "composite_split", ("v_url",),
    _PARTS + """, x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'nvidia/foo/Site' WHEN 1 THEN 'nvidia/wd5' ELSE any_ref[2] END AS slug FROM o)
SELECT id, CASE WHEN regexp_full_match(slug, '[^/]+/wd[^/]*/.+') THEN split_part(slug, '/', 1) END AS tenant,
       CASE WHEN regexp_full_match(slug, '[^/]+/wd[^/]*/.+') THEN split_part(slug, '/', 2) END AS region,
       CASE WHEN regexp_full_match(slug, '[^/]+/wd[^/]*/.+') THEN regexp_replace(slug, '^[^/]*/[^/]*/', '') END AS site FROM x""",
)(
    lambda v: v.select(
        "id",
        urls.composite(
            F.when(F.col("id") % 4 == 0, "nvidia/foo/Site").when(F.col("id") % 4 == 1, "nvidia/wd5").otherwise(
                urls.classify_or_other(F.col("url"))["slug"]
            )
        ).alias("c"),
    ).select("id", "c.tenant", "c.region", "c.site")
)
query(
    "best_url", ("v_url",),
    _PARTS + """, b AS (SELECT id // 5 AS rec, url, any_ref, row_number() OVER (PARTITION BY id // 5 ORDER BY any_ref[1] = 'other', id) AS n
  FROM o WHERE any_ref IS NOT NULL) SELECT rec, url, any_ref[1] AS kind FROM b WHERE n = 1""",
)(
    lambda v: v.where("url is not null").groupBy(F.floor(F.col("id") / 5).alias("rec"))
    .agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "url"))), lambda x: x["url"]).alias("u"))
    .select("rec", urls.best_of(F.col("u")).alias("b")).where("b is not null").select("rec", "b.url", "b.ref.kind")
)
query(
    "posting_url", ("v_url",),
    _PARTS + """SELECT id, CASE ref[1] WHEN 'ashbyhq' THEN 'https://jobs.ashbyhq.com/' || ref[2] || '/7' WHEN 'lever' THEN 'https://jobs.lever.co/' || ref[2] || '/7'
  WHEN 'smartrecruiters' THEN 'https://jobs.smartrecruiters.com/' || ref[2] || '/7' WHEN 'bamboohr' THEN 'https://' || ref[2] || '.bamboohr.com/careers/7'
  WHEN 'recruitee' THEN 'https://' || ref[2] || '.recruitee.com/o/7'
  WHEN 'workday' THEN 'https://' || split_part(ref[2], '/', 1) || '.' || split_part(ref[2], '/', 2) || '.myworkdayjobs.com/en-US/' || split_part(ref[2], '/', 3) || '7' END AS url FROM f""",
)(
    lambda v: v.select("id", urls.classify(F.col("url")).alias("r")).select(
        "id", urls.posting_url(F.col("r.kind"), F.col("r.slug"), F.lit("7")).alias("url")
    )
)
query(
    "kind_match", ("v_url",),
    _PARTS + """SELECT id, ref[2] AS slug FROM f WHERE ref[1] = CASE WHEN id % 2 = 0 THEN 'lever' ELSE 'greenhouse' END""",
)(
    lambda v: discover.kind_matched(
        v.withColumn("kind", F.when(F.col("id") % 2 == 0, "lever").otherwise("greenhouse"))
    ).select("id", "ref.slug")
)

from . import driver_more  # noqa: E402, F401  it registers its queries here
from . import driver_state  # noqa: E402, F401
from . import driver_sync  # noqa: E402, F401
from . import driver_runs  # noqa: E402, F401
