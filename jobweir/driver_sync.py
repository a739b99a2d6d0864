"""Queries of whole syncs and imports, combined listings and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .driver import NOW, VIEWS, query
from .functions import match, text as t
from .operators import listing, merge, reports, textindex
from .plans import pipelines, sync

# --- syncs --------------------------------------------------------------------
# Every customer is a company; even ones publish one list, odd ones pages. A
# seventh of the lists is gone, an eleventh fails; the third page lies beyond the
# total, and failing there does no harm. Some lists were fetched again: a later
# answer replaces a failure, and the list that an earlier one held.

_K = "CAST(c_custkey AS STRING)"
_CODE = "CASE WHEN c_custkey % 7 = 0 THEN 404 WHEN c_custkey % 11 = 0 THEN 500 ELSE 200 END"
_LEVER = f"""'[{{"id":"a' || {_K} || '","text":" Dev ' || {_K} || ' ","categories":{{"location":" ","team":"Eng"}},"descriptionPlain":" New ","workplaceType":"remote"}},' ||
  '{{"id":"b' || {_K} || '","text":"Ops","categories":{{"location":"Berlin"}}}},{{"text":"no id"}}]'"""


def _page(ids: str, total: int) -> str:
    entry = f"""'{{"id":"{ids}' || {_K} || '","name":"{'Dev ' if ids == 'a' else 'Ops'}' || """ + (_K if ids == "a" else "''")
    return f"""'{{"totalFound":{total},"content":[' || {entry} || '","location":{{"fullLocation":"{'' if ids == 'a' else 'Berlin'}","remote":true}}}}]}}'"""


VIEWS["v_firms"] = f"""
SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 2 WHEN 0 THEN 'lever' ELSE 'smartrecruiters' END AS ats_kind, 's' || {_K} AS ats_slug,
  TIMESTAMP '2024-01-01 00:00:00' AS first_seen, TIMESTAMP '2024-02-01 00:00:00' AS last_seen FROM customer"""
VIEWS["v_lists"] = f"""
SELECT 'lever' AS kind, 's' || {_K} AS slug, TIMESTAMP '2029-12-31 00:00:00' AS fetched_at, {_CODE} AS http_status, 0 AS page_offset, {_LEVER} AS body
FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'smartrecruiters', 's' || {_K}, TIMESTAMP '2029-12-31 00:00:00', {_CODE}, 0, {_page('a', 150)} FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'smartrecruiters', 's' || {_K}, TIMESTAMP '2029-12-31 00:00:00', 200, 100, {_page('b', 150)} FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'smartrecruiters', 's' || {_K}, TIMESTAMP '2029-12-31 00:00:00', 500, 200, {_page('c', 150)} FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'lever', 's' || {_K}, TIMESTAMP '2029-12-31 00:05:00', 200, 0, {_LEVER} FROM customer WHERE c_custkey % 22 = 0
UNION ALL SELECT 'smartrecruiters', 's' || {_K}, TIMESTAMP '2029-12-31 00:05:00', 200, 0, {_page('a', 150)} FROM customer WHERE c_custkey % 66 = 33
UNION ALL SELECT 'lever', 's' || {_K}, TIMESTAMP '2029-12-30 23:00:00', 200, 0, '[{{"id":"q' || {_K} || '","text":"Gone"}}]' FROM customer WHERE c_custkey % 26 = 0"""
# a third of the companies has one known job that is still listed, closed for some, and one that is not
VIEWS["v_posts"] = f"""
SELECT c_custkey * 2 + n AS id, c_custkey AS company_id, CASE c_custkey % 2 WHEN 0 THEN 'lever' ELSE 'smartrecruiters' END AS ats_kind,
  CASE n WHEN 0 THEN 'a' ELSE 'z' END || {_K} AS external_id, 'Old' AS title, 'Paris' AS location, CAST(NULL AS STRING) AS department, 'u' AS apply_url,
  'Old text' AS description, FALSE AS remote, CAST(NULL AS STRING) AS posted_at, '{{}}' AS raw_json, TIMESTAMP '2024-01-01 00:00:00' AS first_seen,
  TIMESTAMP '2024-02-01 00:00:00' AS last_seen, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS closed_at, 'applied' AS status
FROM customer, (SELECT 0 AS n UNION ALL SELECT 1) x WHERE c_custkey % 3 = 0"""


def _at() -> Column:
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


_LAST = "g AS (SELECT slug, kind, arg_max(http_status, fetched_at) AS code FROM v_lists WHERE page_offset = 0 GROUP BY slug, kind)"
_GOT = _LAST + """,
f AS (SELECT id AS company_id, ats_kind, ats_slug, substr(ats_slug, 2) AS k, code FROM v_firms JOIN g ON ats_kind = kind AND ats_slug = slug),
e AS (SELECT company_id, ats_kind, p || k AS external_id, CASE p WHEN 'a' THEN 'Dev ' || k ELSE 'Ops' END AS title, CASE p WHEN 'b' THEN 'Berlin' END AS location,
  CASE WHEN p = 'a' AND ats_kind = 'lever' THEN 'Eng' END AS department, CASE WHEN p = 'a' AND ats_kind = 'lever' THEN 'New' END AS description,
  CASE WHEN ats_kind = 'smartrecruiters' OR p = 'a' THEN TRUE END AS remote FROM f, (VALUES ('a'), ('b')) x(p) WHERE code = 200)"""
_SYNC = f"""WITH {_GOT}, j AS (SELECT coalesce(e.ats_kind, s.ats_kind) AS ats_kind, coalesce(e.external_id, s.external_id) AS external_id,
  coalesce(s.company_id, e.company_id) AS company_id, CASE WHEN e.external_id IS NULL THEN s.title ELSE e.title END AS title,
  CASE WHEN e.external_id IS NULL THEN s.location ELSE e.location END AS location, CASE WHEN e.external_id IS NULL THEN s.department ELSE e.department END AS department,
  coalesce(e.description, s.description) AS description, coalesce(e.remote, s.remote) AS remote, coalesce(s.status, 'new') AS status,
  CASE WHEN e.external_id IS NULL THEN NULL WHEN s.external_id IS NULL THEN 'new' ELSE 'known' END AS change, s.closed_at AS was_closed
  FROM e FULL JOIN v_posts s ON e.ats_kind = s.ats_kind AND e.external_id = s.external_id), r AS (
SELECT j.*, f.code, change IS NULL AND (was_closed IS NOT NULL OR code = 200) AS closed, change IS NULL AND was_closed IS NULL AND code = 200 AS swept
FROM j JOIN f ON j.company_id = f.company_id) """
query(
    "sync_kind", ("v_lists", "v_firms", "v_posts"),
    _SYNC + "SELECT ats_kind, external_id, company_id, title, location, department, description, remote, status, change, closed FROM r",
)(
    lambda landed, firms, posts: sync.sync(_ntz(landed), firms, _ntz(posts), _at()).jobs.select(
        "ats_kind", "external_id", "company_id", "title", "location", "department", "description", "remote", "status", "change",
        F.col("closed_at").isNotNull().alias("closed"),
    )
)
query(
    "sync_kind_report", ("v_lists", "v_firms", "v_posts"),
    _SYNC + """SELECT ats_kind AS kind, count(*) FILTER (WHERE code = 200) AS companies_synced, count(*) FILTER (WHERE code = 404) AS companies_404,
  2 * count(*) FILTER (WHERE code = 200) AS jobs_seen, (SELECT count(*) FROM r WHERE r.ats_kind = f.ats_kind AND change = 'new') AS jobs_new,
  (SELECT count(*) FROM r WHERE r.ats_kind = f.ats_kind AND swept) AS jobs_closed FROM f GROUP BY ats_kind""",
)(lambda landed, firms, posts: sync.sync(_ntz(landed), firms, _ntz(posts), _at()).report)

query(
    "sync_ids", ("v_lists", "v_firms", "v_posts"),
    _SYNC + """SELECT change, count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS least, max(id) AS greatest FROM (
SELECT change, CASE WHEN change = 'new' THEN (SELECT max(id) FROM v_posts) + row_number() OVER (PARTITION BY change ORDER BY r.external_id) ELSE s.id END AS id
FROM r LEFT JOIN v_posts s ON r.ats_kind = s.ats_kind AND r.external_id = s.external_id) GROUP BY change""",
)(
    lambda landed, firms, posts: sync.sync(_ntz(landed), firms, _ntz(posts), _at()).jobs.groupBy("change").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("least"), F.max("id").alias("greatest")
    )
)
query(
    "sync_runs", ("v_lists", "v_firms", "v_posts"),
    _SYNC + """SELECT 'sync:' || ats_kind AS source, TRUE AS ok, 2 * count(*) FILTER (WHERE code = 200) AS items_seen,
  (SELECT count(*) FROM r WHERE r.ats_kind = f.ats_kind AND change = 'new') AS items_new FROM f GROUP BY ats_kind""",
)(lambda landed, firms, posts: sync.sync(_ntz(landed), firms, _ntz(posts), _at()).runs.select("source", "ok", "items_seen", "items_new"))

# --- imports --------------------------------------------------------------------
# One line a customer, comments and unknown hosts between them; a fifth of the
# companies is known.
VIEWS["v_lines"] = f"""
SELECT CASE c_custkey % 10 WHEN 9 THEN '# note ' || {_K} WHEN 8 THEN 'https://example.com/' || {_K} WHEN 7 THEN '   '
  ELSE CASE c_custkey % 2 WHEN 0 THEN ' https://jobs.lever.co/s' || {_K} || '/x ' ELSE 'https://jobs.smartrecruiters.com/s' || {_K} END END AS value
FROM customer"""
VIEWS["v_old"] = f"""
SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 2 WHEN 0 THEN 'lever' ELSE 'smartrecruiters' END AS ats_kind, 's' || {_K} AS ats_slug,
  TIMESTAMP '2024-01-01 00:00:00' AS first_seen, TIMESTAMP '2024-02-01 00:00:00' AS last_seen FROM customer WHERE c_custkey % 5 = 0"""
_FRESH = """l AS (SELECT trim(value) AS u FROM v_lines), n AS (
SELECT CASE WHEN u LIKE '%lever%' THEN 'lever' ELSE 'smartrecruiters' END AS ats_kind, regexp_extract(u, '/(s[0-9]+)', 1) AS ats_slug
FROM l WHERE u LIKE '%jobs.%'), c AS (
SELECT DISTINCT n.ats_kind, n.ats_slug, g.code FROM n JOIN g ON n.ats_kind = g.kind AND n.ats_slug = g.slug LEFT JOIN v_old o ON n.ats_kind = o.ats_kind AND n.ats_slug = o.ats_slug WHERE o.id IS NULL)"""


def _imported(lines, landed, old):
    return sync.import_then_sync(lines, _ntz(landed), _ntz(old), _none(landed), _at())


query(
    "import_then_sync", ("v_lines", "v_lists", "v_old"),
    f"""WITH {_LAST}, {_FRESH}
SELECT ats_kind, p || substr(ats_slug, 2) AS external_id, CASE p WHEN 'a' THEN 'Dev ' || substr(ats_slug, 2) ELSE 'Ops' END AS title, 'new' AS change
FROM c, (VALUES ('a'), ('b')) x(p) WHERE code = 200""",
)(lambda lines, landed, old: _imported(lines, landed, old).jobs.select("ats_kind", "external_id", "title", "change"))
query(
    "import_companies", ("v_lines", "v_lists", "v_old"),
    f"""WITH {_LAST}, {_FRESH}
SELECT ats_kind, ats_slug, ats_slug AS name, 'new' AS change FROM c UNION ALL
SELECT o.ats_kind, o.ats_slug, name, CASE WHEN n.ats_slug IS NOT NULL THEN 'known' END FROM v_old o LEFT JOIN n ON o.ats_kind = n.ats_kind AND o.ats_slug = n.ats_slug""",
)(lambda lines, landed, old: _imported(lines, landed, old).companies.select("ats_kind", "ats_slug", "name", "change"))
query(
    "import_discoveries", ("v_lines", "v_lists", "v_old"),
    """WITH l AS (SELECT trim(value) AS u FROM v_lines)
SELECT u AS source_url, 'import:manual' AS discovered_via, regexp_extract(u, '/(s[0-9]+)', 1) AS ats_slug FROM l WHERE u LIKE '%jobs.%'""",
)(
    lambda lines, landed, old: (lambda i: i.discoveries.join(i.companies.select(F.col("id").alias("company_id"), "ats_slug"), "company_id"))(
        _imported(lines, landed, old)
    ).select("source_url", "discovered_via", "ats_slug")
)

query(
    "import_to_run", ("v_lines", "v_lists", "v_old"),
    f"""WITH {_LAST}, {_FRESH} SELECT 'import:manual' AS source, TRUE AS ok, (SELECT count(*) FROM n) AS items_seen,
  (SELECT count(*) FROM (SELECT DISTINCT ats_kind, ats_slug FROM n) x LEFT JOIN v_old o ON x.ats_kind = o.ats_kind AND x.ats_slug = o.ats_slug WHERE o.id IS NULL) AS items_new""",
)(lambda lines, landed, old: _imported(lines, landed, old).run.select("source", "ok", "items_seen", "items_new"))

# --- crawls to state ------------------------------------------------------------


def _none(v: DataFrame) -> DataFrame:
    return v.sparkSession.createDataFrame([], "id bigint, ats_kind string, external_id string, title string, location string, "
        "department string, apply_url string, description string, remote boolean, posted_at string, raw_json string, company_id bigint, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz, closed_at timestamp_ntz, status string")  # fmt: skip


def _crawled(feed: DataFrame, old: DataFrame) -> sync.Crawled:
    batch = pipelines.thread(feed.select("source", F.col("thread").alias("body")))
    return sync.merge_crawl(batch, _ntz(old.where("ats_kind = 'lever'")), _none(feed), "crawl:thread", _at())


_THREAD = "'https://boards.greenhouse.io/acme/jobs/' || CAST(k AS STRING)"
query(
    "crawl_to_jobs", ("v_feed", "v_old"),
    f"""SELECT 'greenhouse' AS ats_kind, CAST(k AS STRING) AS external_id, 'Acme ' || CAST(k AS STRING) || ' | SWE | Remote | link' AS title, {_THREAD} AS apply_url,
  (SELECT max(id) FROM v_old WHERE ats_kind = 'lever') + 1 AS company_id, 'new' AS status, 'new' AS change FROM (SELECT DISTINCT k FROM v_feed)""",
)(lambda v, old: _crawled(v, old).jobs.select("ats_kind", "external_id", "title", "apply_url", "company_id", "status", "change"))
query(
    "crawl_to_companies", ("v_feed", "v_old"),
    """SELECT ats_kind, ats_slug, name, NULL AS change FROM v_old WHERE ats_kind = 'lever' UNION ALL
SELECT 'greenhouse', 'acme', arg_max('Acme ' || CAST(k AS STRING), source), 'new' FROM v_feed""",
)(lambda v, old: _crawled(v, old).companies.select("ats_kind", "ats_slug", "name", "change"))
query(
    "crawl_to_log", ("v_feed", "v_old"),
    f"""SELECT {_THREAD} AS source_url, 'crawl:thread' AS discovered_via, (SELECT max(id) FROM v_old WHERE ats_kind = 'lever') + 1 AS company_id FROM v_feed""",
)(lambda v, old: _crawled(v, old).discoveries.select("source_url", "discovered_via", "company_id"))
query(
    "crawl_to_run", ("v_feed", "v_old"),
    "SELECT 'crawl:thread' AS source, TRUE AS ok, count(*) AS items_seen, count(DISTINCT k) AS items_new FROM v_feed",
)(lambda v, old: _crawled(v, old).run.select("source", "ok", "items_seen", "items_new"))

# --- listings -------------------------------------------------------------------
VIEWS["v_mix"] = """
SELECT o_orderkey AS id, o_custkey AS company_id, 'Rust dev ' || o_orderpriority AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Zürich' ELSE 'Berlin' END AS location,
  CASE o_orderkey % 4 WHEN 0 THEN 'core team' ELSE 'sales' END AS department, 'We write rust. ' || CAST(o_orderkey % 11 AS STRING) AS description,
  'u' AS apply_url, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote, CASE o_orderkey % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'dismissed' ELSE 'new' END AS status,
  CAST(NULL AS STRING) AS posted_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at, o_orderdate AS last_seen FROM orders"""
_MIX = "FROM v_mix j JOIN v_co c ON j.company_id = c.id WHERE closed_at IS NULL AND remote AND status = 'applied' AND department = 'core team' AND location = 'Zürich'"
query("list_jobs_combined", ("v_mix", "v_co"), f"SELECT j.id, c.name AS company, title, location {_MIX}")(
    lambda j, c: listing.list_jobs(
        match.with_tokens(j), c, F.lit(NOW), remote=True, show="applied",
        match=match.phrase(["core", "team"]) & match.term("zurich", ("location",)),
    ).select("id", "company", "title", "location")
)
VIEWS["v_rank"] = """
SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderkey % 9 WHEN 0 THEN 'rust rust rust' WHEN 4 THEN 'rust zig' WHEN 5 THEN 'zig' ELSE 'rust' END AS title, 'x' AS location,
  'y' AS department, CASE WHEN o_orderkey % 4 = 0 THEN 'z z z z zig' ELSE 'z z z z' END AS description, 'u' AS apply_url, o_orderkey % 5 <> 0 AS remote, 'new' AS status, CAST(NULL AS STRING) AS posted_at,
  CASE WHEN o_orderkey % 9 IN (5, 7) THEN o_orderdate END AS closed_at, o_orderdate AS last_seen FROM orders"""
_SCORED = """, a AS (SELECT *, len(title) - len(replace(title, 'rust', 'rus')) AS tf0, CASE WHEN title LIKE '%zig%' THEN 1 ELSE 0 END + CASE WHEN description LIKE '%zig%' THEN 1 ELSE 0 END AS tf1,
  len(string_split(title || ' x y ' || description, ' ')) AS len FROM v_rank),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM a),
k AS (SELECT a.*, -round(""" + " + ".join(
    f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))" for i in (0, 1)
) + """, 6) AS rank FROM a, s)
SELECT k.id, title, rank FROM k JOIN v_co c ON k.company_id = c.id WHERE closed_at IS NULL AND remote ORDER BY rank, k.id"""
query("list_jobs_by_rank", ("v_rank", "v_co"), "WITH " + _SCORED[2:])(
    lambda j, c: listing.list_jobs(match.with_tokens(j), c, F.lit(NOW), remote=True, words=["rust", "zig"]).select("id", "title", F.round("rank", 6).alias("rank"))
)
query("list_jobs_by_rank_page", ("v_rank", "v_co"), "WITH " + _SCORED[2:] + " LIMIT 300 OFFSET 25")(
    lambda j, c: (lambda t: listing.list_jobs(
        t, c, F.lit(NOW), remote=True, words=["rust", "zig"], limit=300, start=25,
        corpus=textindex.corpus(textindex.statistics(textindex.entries(j)), ["rust", "zig"]),
    ))(match.with_tokens(j)).select("id", "title", F.round("rank", 6).alias("rank"))
)
query("list_companies_page", ("v_co",), "SELECT ats_kind, ats_slug, name, last_seen, id FROM v_co ORDER BY last_seen DESC, id LIMIT 40")(
    lambda c: listing.list_companies(c, 40)
)
query(
    "companies_by_kind", ("v_co",),
    "SELECT ats_kind, count(*) OVER (PARTITION BY ats_kind) AS n, id, ats_slug FROM v_co",
)(listing.by_kind)
query("find_slug_kind", ("v_co",), "SELECT id, ats_kind, ats_slug FROM v_co WHERE ats_slug = 'customer-000000002' AND ats_kind = 'lever' OR ats_slug = 'customer-000000009'")(
    lambda c: listing.find_slug(c, "customer-000000002", "lever").unionByName(listing.find_slug(c, "customer-000000009")).select("id", "ats_kind", "ats_slug")
)
query(
    "batch_outcome_all", ("v_run",),
    "SELECT run_id, TRUE AS ran, (SELECT bool_and(ok) FROM v_run) AS batch_ok FROM v_run",
)(lambda v: reports.batch_outcome(v.withColumnRenamed("run_id", "pos"), False).select(F.col("pos").alias("run_id"), "ran", "batch_ok"))

# --- texts ----------------------------------------------------------------------
_ENTITY = ("&rsquo;", "’"), ("&#8211;", "–"), ("&eacute;", "é"), ("&#x20AC;", "€"), ("&hellip;", "…"), ("&rarr;", "→")
VIEWS["v_entity"] = """
SELECT page_id AS id, '<p>Don&rsquo;t &#8211; caf&eacute; ' || CAST(page_id AS STRING) || ' &amp;#x20AC; &#x20AC;</p> &amp;amp;hellip; &nosuch; &rarr;' ||
  CASE page_id % 3 WHEN 0 THEN ' R&amp;amp;D' ELSE '' END AS html FROM pages"""


def _entity_sql(x: str) -> str:
    for name, value in (*_ENTITY, ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


query(
    "html_entities", ("v_entity",),
    # the list of the first pass decodes &amp; once, the second pass all that is left
    "SELECT id, " + _entity_sql("trim(regexp_replace(regexp_replace(replace(html, '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))") + " AS text FROM v_entity",
)(lambda v: v.select("id", t.html_to_text(F.col("html")).alias("text")))
#: Mark-up and what it reads as.
_MARKUP = (
    ("it&#146;s 5&#150;6", "it’s 5–6"), ("caf&eacute &copy 2024 &notit;", "café © 2024 ¬it;"),
    ('<a title="x > y" rel=z>go</a>on', "go on"), ("a < b <3 <b>c</b>", "a < b <3 c "), ("x&#0;y&#xD800;", "x\ufffdy\ufffd"),
    ("<!-- a > b --><p class='>'>t</p> &NotANameAtAll;", "t &NotANameAtAll;"), ("&#x80;&#8364;&#0128;", "€€€"),
)
_HTML = [html.replace("'", "''") for html, _ in _MARKUP]
VIEWS["v_markup"] = "SELECT page_id AS id, CAST(page_id AS STRING) || ' ' || CASE page_id % 7 " + " ".join(
    f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HTML)
) + " END || url AS html FROM pages"
query(
    "html_markup", ("v_markup",),
    "SELECT id, html LIKE '%<%' AS tags, id || ' ' || CASE id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, x) in enumerate(_MARKUP))
    + " END || substring(html, length(id || ' ') + 1 + CASE id % 7 " + " ".join(f"WHEN {i} THEN {len(h)}" for i, (h, _) in enumerate(_MARKUP)) + " END) AS text FROM v_markup",
)(lambda v: v.select("id", F.contains("html", F.lit("<")).alias("tags"), t.html_to_text(F.col("html")).alias("text")))
VIEWS["v_remarks"] = """
SELECT l_orderkey % 997 AS id, CASE l_linenumber % 3 WHEN 0 THEN 'reset' WHEN 1 THEN 'applied' ELSE 'dismissed' END AS status, 'n' AS note, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""
query(
    "mark_repeated", ("v_state", "v_remarks"),
    """WITH m AS (SELECT id, arg_max(status, (seq, status)) AS status FROM v_remarks GROUP BY id)
SELECT s.id, CASE m.status WHEN 'reset' THEN 'new' ELSE coalesce(m.status, s.status) END AS status FROM v_state s LEFT JOIN m ON s.id = m.id""",
)(lambda s, m: merge.mark(s, m, _at(), F.col("seq")).select("id", "status"))
