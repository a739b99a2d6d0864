"""More queries over the test tables: search, merges, reports, pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .driver import _PARTS, NOW, VIEWS, query
from .driver_more import LIST  # noqa: F401  the views of feeds and sites are registered there
from .functions import match, urls
from .operators import discover, listing, merge, reports, textindex
from .plans import pipelines
from .sources.scratch import written

# --- search -----------------------------------------------------------------

_TOK = r"regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}+#.]+')"
_TOKENS = "WITH t AS (SELECT *, " + ", ".join(_TOK.format(c) + f" AS {c}_tokens" for c in match.COLUMNS) + " FROM v_text) "


def _each(cond: str) -> str:
    return "(" + " OR ".join(cond.replace("@", f"{c}_tokens") for c in match.COLUMNS) + ")"


def _match(name: str, where: str, predicate) -> None:
    query(name, ("v_text",), _TOKENS + f"SELECT id FROM t WHERE {where}")(
        lambda v: match.with_tokens(v).where(predicate()).select("id")
    )


query(
    "tokens", ("v_text",), _TOKENS + "SELECT id, " + ", ".join(f"array_to_string({c}_tokens, ' ') AS {c}" for c in match.COLUMNS) + " FROM t",
)(
    lambda v: match.with_tokens(v).select("id", *[F.array_join(f"{c}_tokens", " ").alias(c) for c in match.COLUMNS])
)
_has = lambda w: _each(f"list_contains(@, '{w}')")
_match("match_term", _has("the"), lambda: match.term("the"))
_match("match_and", _has("the") + " AND " + _has("of"), lambda: match.term("the") & match.term("of"))
_match("match_or", _has("der") + " OR " + _has("les"), lambda: match.any_term(["der", "les"]))
_match("match_not", _has("the") + " AND NOT " + _has("of"), lambda: match.term("the") & ~match.term("of"))
_match(
    "match_phrase",
    _each("len(list_filter(range(1, len(@)), lambda i: @[i] = 'of' AND @[i + 1] = 'the')) > 0"),
    lambda: match.phrase(["of", "the"]),
)
_match("match_prefix", _each("len(list_filter(@, lambda x: starts_with(x, 'ther'))) > 0"), lambda: match.prefix("ther"))
_match("match_column", "list_contains(title_tokens, 'the')", lambda: match.term("the", ("title",)))
_match(
    "match_near",
    _each(
        "len(list_filter(range(1, len(@) + 1), lambda i: @[i] = 'the' AND (list_contains(@[greatest(1, i - 3):i - 1], 'with') OR list_contains(@[i + 1:i + 3], 'with')))) > 0"
    ),
    lambda: match.near("the", "with", 2),
)
_AT = lambda p: f"len(list_filter(range(greatest(1, i - 4 - {len(p)}), i + 1), lambda j: " + " AND ".join(f"@[j + {k}] = '{w}'" for k, w in enumerate(p)) + ")) > 0"
_NEAR = [["of", "the"], ["and"], ["with"]]
_match(
    "match_near_all",
    _each("list_contains(@, 'and') AND list_contains(@, 'with') AND len(list_filter(range(1, len(@) + 1), lambda i: " + " AND ".join(map(_AT, _NEAR)) + ")) > 0"),
    lambda: match.near_all(_NEAR, 4),
)


def _bm25_sql(words) -> str:
    tf = ", ".join(f"len(list_filter(a, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))"
        for i in range(len(words))
    )
    return (
        _TOKENS
        + f""", a AS (SELECT id, list_concat(list_concat(title_tokens, location_tokens), list_concat(department_tokens, description_tokens)) AS a FROM t),
c AS (SELECT id, len(a) AS len, {tf} FROM a), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM c)
SELECT id, round(-({score}), 6) AS rank FROM c, s"""
    )


query("rank_bm25", ("v_text",), _bm25_sql(["the", "der"]))(
    lambda v: match.bm25(match.with_tokens(v), ["the", "der"]).select("id", F.round("rank", 6).alias("rank"))
)
VIEWS["v_jobtext"] = """
SELECT o_orderkey AS id, o_custkey AS company_id, 'C++ dev ' || o_orderpriority AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Zürich' END AS location,
  CASE o_orderkey % 4 WHEN 0 THEN 'Rust team' ELSE 'Trusted' END AS department, 'We write rust. And Go ' || CAST(o_orderkey % 11 AS STRING) AS description,
  'u' AS apply_url, CAST(NULL AS BOOLEAN) AS remote, 'new' AS status, CAST(NULL AS STRING) AS posted_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at, o_orderdate AS last_seen
FROM orders"""
query(
    "list_jobs_match", ("v_jobtext", "v_co"),
    """SELECT j.id, c.name AS company, title FROM v_jobtext j JOIN v_co c ON j.company_id = c.id
WHERE closed_at IS NULL AND department = 'Rust team'""",
)(
    lambda j, c: listing.list_jobs(
        match.with_tokens(j), c, F.lit(NOW), match=match.term("rust") & match.phrase(["c++", "dev"]), words=["rust"]
    ).select("id", "company", "title")
)

# --- match data kept in step --------------------------------------------------
# A seventh of the jobs changes its texts, an eleventh is deleted, a thirteenth
# is new, a fifth is only closed.
VIEWS["v_before"] = """
SELECT o_orderkey AS id, 'Rust dev ' || o_orderpriority AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Łódź' ELSE 'Győr' END AS location,
  CASE o_orderkey % 4 WHEN 0 THEN 'Škoda team' END AS department, 'Requests n' || CAST(o_custkey AS STRING) || ' of k' || CAST(o_custkey % 97 AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN ' Rust rust' ELSE '' END AS description
FROM orders WHERE o_orderkey % 13 <> 0"""
VIEWS["v_edits"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Rust dev ' || o_orderpriority ELSE 'zig dev' END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN 'Łódź' ELSE 'Győr' END AS location, CASE o_orderkey % 4 WHEN 0 THEN 'Škoda team' END AS department,
  'Requests n' || CAST(o_custkey AS STRING) || ' of k' || CAST(o_custkey % 97 AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN ' Rust rust' ELSE '' END AS description
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 13 = 0"""
VIEWS["v_gone"] = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 = 0"
_AFTER = (
    "WITH v_text AS (SELECT * FROM v_edits WHERE id NOT IN (SELECT id FROM v_gone) UNION ALL SELECT * FROM v_before "
    "WHERE id NOT IN (SELECT id FROM v_edits UNION ALL SELECT id FROM v_gone)), " + _TOKENS[5:]
)
_FLAT = "list_concat(list_concat(title_tokens, location_tokens), list_concat(department_tokens, description_tokens))"


def _kept(before: DataFrame, edits: DataFrame, gone: DataFrame):
    old = written(textindex.entries(before), "index")
    new = textindex.changed(old, edits, gone)
    return new.index, textindex.added(textindex.statistics(old), new.delta)


query(
    "term_statistics", ("v_before", "v_edits", "v_gone"),
    _AFTER + f"""SELECT term, count(*) AS docs, 0 AS total FROM (SELECT unnest(list_distinct({_FLAT})) AS term FROM t) GROUP BY term
UNION ALL SELECT '', count(*), sum(len({_FLAT})) FROM t""",
)(lambda *v: _kept(*v)[1])
query("rank_by_statistics", ("v_before", "v_edits", "v_gone"), _AFTER + ", " + _bm25_sql(["rust", "zig"])[len(_TOKENS) + 1 :])(
    lambda *v: (lambda i, s: textindex.ranked(i, textindex.corpus(s, ["rust", "zig"]), ["rust", "zig"]))(*_kept(*v)).select(
        "id", F.round("rank", 6).alias("rank")
    )
)
query(
    "best_by_rank", ("v_before", "v_edits", "v_gone"),
    _AFTER + ", " + _bm25_sql(["rust", "k5"])[len(_TOKENS) + 1 :] + " ORDER BY rank, id LIMIT 100",
)(
    lambda *v: (lambda i, s: textindex.best(i, textindex.bounds(i, ["rust", "k5"]), textindex.corpus(s, ["rust", "k5"]), ["rust", "k5"], 100))(
        *_kept(*v)
    ).select("id", F.round("rank", 6).alias("rank"))
)

# --- merges -----------------------------------------------------------------



def _at() -> Column:
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


def _seq() -> Column:
    return F.struct("ts", "o", "n", "title")


_POLICY = {"title": "overwrite", "description": "coalesce", "company_id": "keep"}
_LAST = """WITH b AS (SELECT k, arg_max(title, (ts, o, n, title)) AS title, arg_max(description, (ts, o, n, title)) FILTER (WHERE description IS NOT NULL) AS description,
  arg_min(company_id, (ts, o, n, title)) AS company_id, count(*) AS seen FROM v_batch GROUP BY k) """
query("upsert_dups", ("v_batch",), _LAST + "SELECT k, title, description, company_id, seen FROM b")(
    lambda b: merge.last_write(b, ("k",), _POLICY, _seq()).withColumnRenamed("_seen", "seen")
)
query(
    "upsert_jobs", ("v_snap", "v_batch"),
    _LAST + """SELECT k, CASE WHEN b.k IS NOT NULL THEN b.title ELSE s.title END AS title, coalesce(b.description, s.description) AS description,
  coalesce(s.company_id, b.company_id) AS company_id, coalesce(s.first_seen, TIMESTAMP '2030-01-01') AS first_seen,
  CASE WHEN b.k IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE s.last_seen END AS last_seen, CASE WHEN b.k IS NULL THEN closed_at END AS closed_at,
  coalesce(status, 'new') AS status, CASE WHEN b.k IS NOT NULL AND s.k IS NOT NULL THEN 'known' WHEN b.k IS NOT NULL THEN 'new' END AS change
FROM v_snap s FULL JOIN b USING (k)""",
)(lambda s, b: merge.upsert_jobs(s, b, _seq(), _at(), ("k",), _POLICY))
query(
    "reopen", ("v_snap", "v_batch"),
    "SELECT k FROM v_snap WHERE closed_at IS NOT NULL AND k IN (SELECT k FROM v_batch)",
)(
    lambda s, b: merge.upsert_jobs(s, b, _seq(), _at(), ("k",), _POLICY).where("change = 'known' and closed_at is null").select("k")
    .join(s.where("closed_at is not null").select("k"), "k")
)
query("new_keys", ("v_snap", "v_batch"), "SELECT DISTINCT k FROM v_batch WHERE k NOT IN (SELECT k FROM v_snap)")(
    lambda s, b: merge.new_keys(b, s, ("k",))
)
query("fresh_only", ("v_snap", "v_batch"), "SELECT k, title FROM v_batch WHERE k NOT IN (SELECT k FROM v_snap)")(
    lambda s, b: merge.only_for(b, merge.new_keys(b, s, ("k",)), ("k",)).select("k", "title")
)
query(
    "new_ids", ("v_snap", "v_batch"),
    """SELECT k, 1000 + row_number() OVER (ORDER BY k % 16, k) AS id FROM (SELECT DISTINCT k FROM v_batch WHERE k NOT IN (SELECT k FROM v_snap))""",
)(lambda s, b: merge.assign_ids(merge.new_keys(b, s, ("k",)), 1000, ["k"], F.col("k") % 16))


def _swept(s: DataFrame) -> DataFrame:
    jobs = s.select("k", F.floor(F.col("k") / 100).alias("company_id"), (F.col("k") % 2).alias("ats_kind"), "last_seen", "closed_at")
    synced = (
        jobs.where("company_id % 3 = 0").select("company_id", "ats_kind").distinct()
        .withColumn("started_at", F.lit("1998-10-01 00:00:00").cast("timestamp_ntz"))
    )
    return merge.sweep(jobs, synced, _at())


query(
    "sweep", ("v_snap",),
    """SELECT k, k // 100 AS company_id, k % 2 AS ats_kind, last_seen,
  CASE WHEN closed_at IS NULL AND k // 100 % 3 = 0 AND last_seen < TIMESTAMP '1998-10-01' THEN TIMESTAMP '2030-01-01' ELSE closed_at END AS closed_at FROM v_snap""",
)(_swept)
VIEWS["v_sight"] = """
SELECT o_orderkey AS seq, o_custkey AS k, CASE o_custkey % 2 WHEN 0 THEN 'lever' ELSE 'greenhouse' END AS ats_kind, 's' || CAST(o_custkey AS STRING) AS ats_slug,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N' || CAST(o_orderkey AS STRING) END AS name_hint, 'u' || CAST(o_orderkey AS STRING) AS source_url FROM orders"""
VIEWS["v_known"] = """
SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 2 WHEN 0 THEN 'lever' ELSE 'greenhouse' END AS ats_kind,
  's' || CAST(c_custkey AS STRING) AS ats_slug, TIMESTAMP '2024-01-01 00:00:00' AS first_seen, TIMESTAMP '2024-02-01 00:00:00' AS last_seen FROM customer WHERE c_custkey % 2 = 0"""


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


query(
    "upsert_companies", ("v_known", "v_sight"),
    """WITH b AS (SELECT ats_kind, ats_slug, arg_max(name_hint, seq) FILTER (WHERE name_hint IS NOT NULL) AS hint FROM v_sight GROUP BY ALL)
SELECT ats_kind, ats_slug, coalesce(hint, name, ats_slug) AS name, id, coalesce(first_seen, TIMESTAMP '2030-01-01') AS first_seen,
  CASE WHEN b.ats_slug IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE last_seen END AS last_seen,
  CASE WHEN b.ats_slug IS NULL THEN NULL WHEN id IS NULL THEN 'new' ELSE 'known' END AS change
FROM v_known FULL JOIN b USING (ats_kind, ats_slug)""",
)(lambda c, b: merge.upsert_companies(_ntz(c), b, F.col("seq"), _at()))
query(
    "discoveries", ("v_known", "v_sight"),
    """SELECT id AS company_id, 'discover:brave' AS discovered_via, TIMESTAMP '2030-01-01' AS discovered_at, source_url FROM v_sight JOIN v_known USING (ats_kind, ats_slug)""",
)(lambda c, b: merge.discoveries(b, c, F.lit("discover:brave"), _at()))
VIEWS["v_state"] = """
SELECT o_orderkey AS id, o_custkey AS company_id, CASE o_orderkey % 5 WHEN 0 THEN 'applied' ELSE 'new' END AS status, CAST(NULL AS STRING) AS status_note,
  o_orderdate AS status_changed_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at FROM orders"""
VIEWS["v_marks"] = """
SELECT l_orderkey * 3 AS id, max(CASE l_orderkey % 3 WHEN 0 THEN 'reset' WHEN 1 THEN 'applied' ELSE 'dismissed' END) AS status,
  max(CASE WHEN l_linenumber % 2 = 0 THEN 'n' END) AS note FROM lineitem GROUP BY l_orderkey"""
query(
    "mark_ids", ("v_state", "v_marks"),
    """SELECT s.id, company_id, CASE WHEN m.id IS NULL THEN s.status WHEN m.status = 'reset' THEN 'new' ELSE m.status END AS status,
  CASE WHEN m.id IS NULL THEN status_note ELSE note END AS status_note, CASE WHEN m.id IS NULL THEN status_changed_at ELSE TIMESTAMP '2030-01-01' END AS status_changed_at, closed_at
FROM v_state s LEFT JOIN v_marks m ON s.id = m.id""",
)(lambda s, m: merge.mark(s, m, _at()))
query("mark_failures", ("v_state", "v_marks"), "SELECT id FROM v_marks WHERE id NOT IN (SELECT id FROM v_state)")(
    lambda s, m: merge.mark_failures(s, m).select("id")
)
query(
    "report_mark", ("v_state", "v_marks"),
    "SELECT count(s.id) AS ok, count(*) AS total, count(*) - count(s.id) AS failed FROM v_marks m LEFT JOIN v_state s ON s.id = m.id",
)(lambda s, m: reports.mark_report(m, s))
query(
    "mark_company", ("v_state",),
    """SELECT id, CASE WHEN closed_at IS NULL AND company_id % 10 = 1 THEN 'dismissed' ELSE status END AS status,
  CASE WHEN closed_at IS NULL AND company_id % 10 = 1 THEN 'why' ELSE status_note END AS status_note FROM v_state""",
)(
    lambda s: merge.mark_company(
        s, s.where("company_id % 10 = 1").select("company_id"), "dismissed", "why", _at()
    ).select("id", "status", "status_note")
)
VIEWS["v_sel"] = """
SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'company:lever/s' || CAST(c_custkey % 50 AS STRING) WHEN 1 THEN 'company:s' || CAST(c_custkey % 70 AS STRING)
  WHEN 2 THEN 'company:none' || CAST(c_custkey % 5 AS STRING) ELSE 'company:workday/t/wd5/S' END AS selector FROM customer"""
VIEWS["v_cos"] = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' ELSE 'workday' END AS ats_kind,
  CASE WHEN c_custkey = 2 THEN 't/wd5/S' ELSE 's' || CAST(c_custkey % 60 AS STRING) END AS ats_slug FROM customer"""
query(
    "resolve_selector", ("v_sel", "v_cos"),
    """WITH p AS (SELECT selector, substr(selector, 9) AS r FROM v_sel), q AS (SELECT selector, CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) END AS kind,
  CASE WHEN contains(r, '/') THEN substr(r, strpos(r, '/') + 1) ELSE r END AS slug FROM p)
SELECT selector, CASE count(id) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome, CASE WHEN count(id) = 1 THEN min(id) END AS company_id,
  coalesce(string_agg(ats_kind || '/' || ats_slug, ',' ORDER BY ats_kind || '/' || ats_slug), '') AS matches
FROM q LEFT JOIN v_cos c ON q.slug = c.ats_slug AND (q.kind IS NULL OR q.kind = c.ats_kind) GROUP BY selector""",
)(
    lambda s, c: merge.resolve_selectors(s, c)
    .withColumn("matches", F.when(F.col("outcome") == "none", "").otherwise(F.col("matches")))
)
# The same job over all companies: every customer is a company and names a
# selector; a few slugs are shared by two or three kinds.
VIEWS["v_sel_all"] = """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'company:lever/s' || CAST(c_custkey AS STRING) WHEN 1 THEN 'company:s' || CAST(c_custkey AS STRING)
  WHEN 2 THEN 'company:none' || CAST(c_custkey AS STRING) ELSE 'company:workday/t/wd5/S' || CAST(c_custkey AS STRING) END AS selector FROM customer"""
VIEWS["v_cos_all"] = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' ELSE 'workday' END AS ats_kind,
  CASE WHEN c_custkey % 12 = 11 THEN 't/wd5/S' || CAST(c_custkey AS STRING)
    WHEN c_custkey % 20 IN (2, 3) THEN 's' || CAST(c_custkey - c_custkey % 20 + 1 AS STRING)
    ELSE 's' || CAST(c_custkey AS STRING) END AS ats_slug FROM customer"""
query(
    "resolve_selector_all", ("v_sel_all", "v_cos_all"),
    """WITH p AS (SELECT selector, substr(selector, 9) AS r FROM v_sel_all), q AS (SELECT selector, CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) END AS kind,
  CASE WHEN contains(r, '/') THEN substr(r, strpos(r, '/') + 1) ELSE r END AS slug FROM p)
SELECT selector, CASE count(id) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome, CASE WHEN count(id) = 1 THEN min(id) END AS company_id,
  coalesce(string_agg(ats_kind || '/' || ats_slug, ',' ORDER BY ats_kind || '/' || ats_slug), '') AS matches
FROM q LEFT JOIN v_cos_all c ON q.slug = c.ats_slug AND (q.kind IS NULL OR q.kind = c.ats_kind) GROUP BY selector""",
)(
    lambda s, c: merge.resolve_selectors(s, c)
    .withColumn("matches", F.when(F.col("outcome") == "none", "").otherwise(F.col("matches")))
)
VIEWS["v_meta"] = "SELECT c_mktsegment || CAST(c_custkey % 9 AS STRING) AS key, max(c_name) AS value FROM customer GROUP BY c_mktsegment || CAST(c_custkey % 9 AS STRING)"
VIEWS["v_put"] = "SELECT c_mktsegment || CAST(c_custkey % 13 AS STRING) AS key, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS value, c_custkey AS seq FROM customer"
query(
    "meta_upsert", ("v_meta", "v_put"),
    """WITH b AS (SELECT key, max(seq) AS s FROM v_put GROUP BY key), l AS (SELECT v_put.key, value AS v FROM v_put JOIN b ON b.key = v_put.key AND b.s = v_put.seq)
SELECT coalesce(m.key, l.key) AS key, CASE WHEN l.key IS NOT NULL THEN v ELSE value END AS value FROM v_meta m FULL JOIN l ON m.key = l.key""",
)(lambda m, b: merge.put_meta(m, b, F.col("seq")))

# --- reports ----------------------------------------------------------------

query(
    "run_log", ("v_run",),
    """SELECT 'sync:' || source AS source, started_at, started_at AS finished_at, ok, CASE WHEN ok THEN 200 ELSE 500 END AS http_status, items_seen, items_new,
  CASE WHEN NOT ok THEN 'failed' END AS error FROM v_run""",
)(
    lambda v: merge.run_row(
        v, F.concat(F.lit("sync:"), "source"), F.col("started_at"), F.col("started_at"), F.col("ok"), F.col("items_seen"),
        F.col("items_new"), F.when(F.col("ok"), 200).otherwise(500), F.when(~F.col("ok"), "failed"),
    )
)
query(
    "source_health", ("v_run",),
    """SELECT source, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok_runs, arg_max(ok, (started_at, run_id)) AS last_ok,
  sum(items_seen)::BIGINT AS items_seen, sum(items_new)::BIGINT AS items_new FROM v_run GROUP BY source""",
)(reports.source_health)
query(
    "report_crawl", ("v_run",),
    """SELECT source, count(*) AS pages_visited, count(*) FILTER (WHERE run_id % 2 = 0) AS apply_links_found, count(*) FILTER (WHERE run_id % 4 = 0) AS jobs_matched,
  count(*) FILTER (WHERE run_id % 8 = 0) AS jobs_new, count(*) FILTER (WHERE run_id % 16 = 0) AS companies_new FROM v_run GROUP BY source""",
)(
    lambda v: reports.crawl_report(
        v.select(
            "source", F.when(F.col("run_id") % 2 == 0, "u").alias("apply_url"), (F.col("run_id") % 4 == 0).alias("matched"),
            (F.col("run_id") % 8 == 0).alias("job_is_new"), (F.col("run_id") % 16 == 0).alias("company_is_new"),
        )
    )
)
query(
    "report_sync", ("v_run",),
    """SELECT source AS kind, count(*) FILTER (WHERE ok) AS companies_synced, count(*) FILTER (WHERE NOT ok AND run_id % 2 = 0) AS companies_404,
  count(*) FILTER (WHERE run_id % 3 > 0) AS jobs_seen, count(*) FILTER (WHERE run_id % 5 = 0) AS jobs_new, count(*) FILTER (WHERE run_id % 11 = 0) AS jobs_closed FROM v_run GROUP BY source""",
)(
    lambda v: reports.sync_report(
        v.select(F.col("source").alias("kind"), F.when(F.col("ok"), "ok").when(F.col("run_id") % 2 == 0, "stale").otherwise("failed").alias("outcome")),
        v.where("run_id % 3 > 0").select(F.col("source").alias("kind")),
        v.select(F.col("source").alias("kind"), F.when(F.col("run_id") % 5 == 0, "new").otherwise("known").alias("change")),
        v.where("run_id % 11 = 0").select(F.col("source").alias("kind")),
    )
)
query(
    "batch_outcome", ("v_run",),
    """SELECT run_id, run_id <= min(CASE WHEN NOT ok THEN run_id END) OVER () AS ran, min(CASE WHEN NOT ok THEN run_id END) OVER () IS NULL AS batch_ok FROM v_run""",
)(lambda v: reports.batch_outcome(v.withColumnRenamed("run_id", "pos"), True).select(F.col("pos").alias("run_id"), "ran", "batch_ok"))
query(
    "report_import", ("v_url", "v_co"),
    _PARTS + """, c AS (SELECT ref[1] AS kind, ref[2] AS slug, ref[1] IS NOT NULL AND ref[2] LIKE '%1' AS known FROM f),
g AS (SELECT kind, slug, known, count(*) AS n FROM c GROUP BY ALL)
SELECT count(*) FILTER (WHERE kind IS NOT NULL AND NOT known) AS companies_new,
  coalesce(sum(CASE WHEN kind IS NULL THEN 0 WHEN known THEN n ELSE n - 1 END), 0)::BIGINT AS already_known,
  coalesce(sum(CASE WHEN kind IS NULL THEN n END), 0)::BIGINT AS skipped, (coalesce(sum(CASE WHEN kind IS NOT NULL THEN n END), 0))::BIGINT AS items_seen FROM g""",
)(
    lambda v, c: (lambda u: reports.import_report(
        u, u.where("ref.slug like '%1'").select(F.col("ref.kind").alias("ats_kind"), F.col("ref.slug").alias("ats_slug"))
    ))(v.select(urls.classify(F.col("url")).alias("ref")))
)

# --- discovery --------------------------------------------------------------
VIEWS["v_found"] = """
SELECT CASE o_orderkey % 6 WHEN 0 THEN 'site:jobs.lever.co "Remote"' WHEN 1 THEN 'site:boards.greenhouse.io "Remote"' WHEN 2 THEN 'site:recruitee.com "Remote"'
  WHEN 3 THEN 'site:myworkdayjobs.com "Remote"' ELSE 'other' END AS query,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://jobs.lever.co/c' || CAST(o_custkey AS STRING) WHEN 1 THEN 'https://boards.greenhouse.io/g' || CAST(o_custkey AS STRING) || '/jobs/1'
  WHEN 2 THEN 'https://r' || CAST(o_custkey AS STRING) || '.recruitee.com/o/x' WHEN 3 THEN 'https://example.com/' ELSE 'https://www.recruitee.com/o' END AS url FROM orders"""
_PLAN = "p AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{q}')" for k, q in discover.PLANS) + ") p(kind, query))"
_HITS = f"""WITH {_PLAN}, h AS (SELECT kind, query, url FROM p LEFT JOIN v_found USING (query)), r AS (SELECT *,
  CASE WHEN url LIKE 'https://jobs.lever.co/%' THEN 'lever' WHEN url LIKE 'https://boards.greenhouse.io/%' THEN 'greenhouse' WHEN url LIKE 'https://r%.recruitee.com/o/x' THEN 'recruitee' END AS hit_kind,
  regexp_extract(url, '(?:lever.co/|greenhouse.io/|https://)([a-z]+[0-9]+)', 1) AS slug FROM h) """
query("plan_hits", ("v_found",), _HITS + "SELECT kind, query, url FROM h")(
    lambda v: discover.plan_hits(discover.plans(v.sparkSession), v)
)
query("discover_run", ("v_found",), _HITS + "SELECT kind AS ats_kind, slug AS ats_slug, CAST(NULL AS STRING) AS name_hint, url AS source_url FROM r WHERE hit_kind = kind")(
    lambda v: pipelines.discovered(discover.plans(v.sparkSession), v)
)


@query(
    "report_discover", ("v_found",),
    _HITS + """SELECT kind, count(DISTINCT query) AS queries_sent, count(url) AS urls_seen, count(*) FILTER (WHERE hit_kind = kind) AS urls_classified,
  count(DISTINCT CASE WHEN hit_kind = kind THEN slug END) AS companies_seen, count(DISTINCT CASE WHEN hit_kind = kind AND slug LIKE '%7' THEN slug END) AS companies_new
FROM r GROUP BY kind""",
)
def report_discover(v):
    plan = discover.plans(v.sparkSession)
    hits = discover.plan_hits(plan, v).where("url is not null").withColumn("r", urls.classify(F.col("url")))
    hits = hits.select(
        "kind", "url", F.col("r.kind").alias("hit_kind"), F.col("r.slug").alias("slug"), F.col("r.slug").endswith("7").alias("company_is_new")
    )
    return reports.discover_report(plan, hits)


query(
    "merge_engines", ("v_known", "v_sight"),
    "SELECT ats_kind, ats_slug FROM v_known UNION SELECT ats_kind, ats_slug FROM v_sight",
)(lambda a, b: discover.merge_engines(a, b))

# --- pipelines --------------------------------------------------------------

_BATCH = "ats_kind, ats_slug, external_id, name_hint, source_url, title, location, department, apply_url, description, remote, posted_at"


def _shown(b: DataFrame, *keys: str) -> DataFrame:
    return b.select(*keys, *_BATCH.split(", "))


def _null(*names: str) -> str:
    return ", ".join(f"NULL AS {n}" for n in names)


_CK = "CAST(k AS STRING)"
query(
    "crawl_rss", ("v_feed",),
    f"""SELECT source, 'lever' AS ats_kind, 'acme' AS ats_slug, {_CK} AS external_id, 'Acme' AS name_hint, 'https://c/' || {_CK} AS source_url, 'Dev' AS title,
  NULL AS location, 'Eng' AS department, 'https://jobs.lever.co/acme/' || {_CK} AS apply_url, 'Build & ship.' AS description, TRUE AS remote, 'Jun 02, 2026' AS posted_at FROM v_feed""",
)(lambda v: _shown(pipelines.structured_rss(v.select("source", F.col("cdata").alias("body"))), "source"))
query(
    "crawl_thread", ("v_feed",),
    f"""SELECT source, 'greenhouse' AS ats_kind, 'acme' AS ats_slug, {_CK} AS external_id, 'Acme ' || {_CK} AS name_hint, 'https://boards.greenhouse.io/acme/jobs/' || {_CK} AS source_url,
  'Acme ' || {_CK} || ' | SWE | Remote | link' AS title, {_null('location', 'department')}, 'https://boards.greenhouse.io/acme/jobs/' || {_CK} AS apply_url,
  {_null('description', 'remote', 'posted_at')} FROM v_feed""",
)(lambda v: _shown(pipelines.thread(v.select("source", F.col("thread").alias("body"))), "source"))
query(
    "crawl_feed", ("v_feed",),
    f"""SELECT source, 'lever' AS ats_kind, 'c' || {_CK} AS ats_slug, 'j' AS external_id, 'C' AS name_hint, 'https://feed' AS source_url, 'Dev' AS title, 'Anywhere' AS location,
  'IT' AS department, 'https://jobs.lever.co/c' || {_CK} || '/j' AS apply_url, 'Hi & Brand' || substr(b, 6) AS description, TRUE AS remote, 'd' AS posted_at
FROM (SELECT *, regexp_extract(feed, '&amp; ([^<]*)</p>', 1) AS b FROM v_feed) WHERE k % 2 = 0""",
)(
    lambda v: _shown(
        pipelines.json_feed(
            v.select("source", F.col("feed").alias("body")),
            v.where("k % 2 = 0").select(
                F.concat(F.lit("https://w/job/go/"), "k").alias("url"), F.concat(F.lit("https://jobs.lever.co/c"), "k", F.lit("/j")).alias("final_url")
            ),
            "https://feed",
        ),
        "source",
    )
)


def _site(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    listing_ = v.select(F.col("id").alias("source"), "html")
    return listing_, v


@query(
    "crawl_listing", ("v_site",),
    """SELECT id AS source, kind AS ats_kind, slug AS ats_slug, external_id, NULL AS name_hint, url AS source_url, 'T' AS title, """ + _null("location", "department")
    + """, href AS apply_url, """ + _null("description", "remote", "posted_at") + """ FROM (
  SELECT id, 'https://own.io/jobs/abcdef0123456789' || CAST(id % 3 AS STRING) AS url, 'other' AS kind, 'acme.example' AS slug, 'careers' AS external_id,
    'https://acme.example/careers?p=' || CAST(id % 3 AS STRING) AS href FROM v_site)""",
)
def crawl_listing(v):
    n = F.col("id").cast("string")
    details = v.select(
        F.concat(F.lit("https://own.io/jobs/abcdef0123456789"), n).alias("url"),
        F.concat(F.lit('<title>x</title><h1>T</h1><a href="https://acme.example/careers?p='), n, F.lit('">go</a>')).alias("html"),
    )
    return _shown(pipelines.listing_with_details(v.select(F.col("id").alias("source"), "html"), details, "own.io"), "source")


@query(
    "crawl_rss_pages", ("v_feed",),
    f"""SELECT source, 'lever' AS ats_kind, 'acme' AS ats_slug, {_CK} AS external_id, 'Co' || {_CK} AS name_hint, 'https://l/' || {_CK} AS source_url, 'Role & more' AS title,
  {_null('location', 'department')}, 'https://jobs.lever.co/acme/' || {_CK} || '?ref=own.io' AS apply_url, {_null('description', 'remote', 'posted_at')} FROM v_feed""",
)
def crawl_rss_pages(v):
    pages = v.select(
        F.concat(F.lit("https://l/"), "k").alias("url"),
        F.concat(F.lit('<a href="https://acme.example/">home</a><a href="https://jobs.lever.co/acme/'), "k", F.lit('?ref=own.io">Apply</a>')).alias("html"),
    )
    feed = v.select("source", F.col("rss").alias("body"))
    return _shown(pipelines.rss_with_pages(feed, pages, "own.io", "ref=own.io"), "source")


@query(
    "crawl_button", ("v_site",),
    """SELECT id AS source, 'other' AS ats_kind, 'acme.example' AS ats_slug, 'go' AS external_id, NULL AS name_hint, 'https://own.io/dev-role/' || CAST(id AS STRING) AS source_url,
  'dev role' AS title, """ + _null("location", "department") + """, 'https://acme.example/go' AS apply_url, """ + _null("description", "remote", "posted_at") + """ FROM v_site WHERE id % 2 = 0""",
)
def crawl_button(v):
    # odd pages lead to a login page and give nothing
    to = F.when(F.col("id") % 2 == 0, "https://acme.example/go").otherwise("https://acme.example/auth/login")
    pages = v.select(
        F.concat(F.lit("https://own.io/dev-role/"), "id").alias("url"), F.concat(F.lit('<a href="'), to, F.lit('">Apply now</a>')).alias("html")
    )
    rows = pipelines.listing_with_button(v.select(F.col("id").alias("source"), "html"), pages, ("own.io",), "own.io", "source=own.io")
    return _shown(rows, "source")


query(
    "crawl_marker", ("v_site",),
    f"""SELECT id AS source, 'lever' AS ats_kind, 'acme' AS ats_slug, CAST(id AS STRING) AS external_id, NULL AS name_hint, u AS source_url, 'Lever' AS title, {_null('location', 'department')},
  u AS apply_url, NULL AS description, TRUE AS remote, NULL AS posted_at FROM (SELECT id, 'https://jobs.lever.co/acme/' || CAST(id AS STRING) || '?ref=own.io' AS u FROM v_site WHERE id % 3 = 0)""",
)(lambda v: _shown(pipelines.marker_listing(v.select(F.col("id").alias("source"), "html"), "ref=own.io"), "source"))
query(
    "import_run", ("v_url",),
    _PARTS + "SELECT DISTINCT ref[1] AS ats_kind, ref[2] AS ats_slug FROM f WHERE ref IS NOT NULL",
)(
    lambda v: v.select(urls.classify(F.col("url")).alias("r")).where("r is not null")
    .select(F.col("r.kind").alias("ats_kind"), F.col("r.slug").alias("ats_slug")).distinct()
)


@query(
    "sync_once", ("v_snap", "v_batch"),
    _LAST + """SELECT k, CASE WHEN b.k IS NOT NULL THEN b.title ELSE s.title END AS title, CASE WHEN b.k IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE s.last_seen END AS last_seen,
  CASE WHEN b.k IS NOT NULL THEN NULL WHEN closed_at IS NULL AND k % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE closed_at END AS closed_at
FROM v_snap s FULL JOIN b USING (k)""",
)
def sync_once(s, b):
    """Merge, then sweep the synced half of the companies."""
    out = merge.upsert_jobs(s, b, _seq(), _at(), ("k",), _POLICY)
    out = out.withColumns({"company_id": F.col("k") % 2, "ats_kind": F.lit("x")})
    synced = out.sparkSession.createDataFrame([(0, "x")], "company_id long, ats_kind string").withColumn("started_at", _at())
    return merge.sweep(out, synced, _at()).select("k", "title", "last_seen", "closed_at")
