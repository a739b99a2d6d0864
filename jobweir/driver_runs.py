"""Queries of runs: streams of pages and postings, buckets, ids, chains, health,
deep pages, drift of payloads, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .driver import VIEWS, query
from .driver_more import _pages_sql
from .driver_state import _LAST, _POLICY, _at, _seq
from .operators import listing, merge, reports
from .schemas import JOBS
from .sources import landed, store
from .sources.scratch import shared_dir, written
from .streaming import merge as stream_merge, pages as page_stream


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobweir/{name}-{uuid.uuid4().hex}"


# --- page sets as they arrive -----------------------------------------------------
# Pages come in three batches, whatever their order, some of them twice; time then
# passes, so that what is not over by then is closed by it. A batch is what has
# landed when the stream is started again, in as many files as it has.


def _streamed(v: DataFrame) -> DataFrame:
    spark = v.sparkSession
    folder = _folder(spark, "page-stream")
    rows = v.select(
        "kind", "slug", F.lit("r").alias("run"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"), "http_status",
        "page_offset", F.col("n").alias("n_entries"), F.col("total").cast("bigint").alias("total"), F.lit("b").alias("body"),
    )
    rows = written(rows, "landing")
    part = F.pmod(F.xxhash64("slug", "page_offset"), F.lit(3))
    again = (F.pmod(F.xxhash64("slug"), F.lit(5)) == 0) & (F.col("page_offset") == 0)
    batches = [rows.where((part == i) | (again if i == 2 else F.lit(False))) for i in range(3)]
    for i in range(2):
        end = spark.createDataFrame([("k", f"end{i}", "r", 200, 0, 1, 1, "b")], "kind string, slug string, run string, http_status int, page_offset int, n_entries int, total bigint, body string")
        batches.append(end.withColumn("fetched_at", F.lit(f"2024-01-0{i + 2} 00:00:00").cast("timestamp")).select(*rows.columns))
    for i, batch in enumerate(batches):
        batch.write.parquet(f"{folder}/in/b{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        run = (
            page_stream.page_sets(stream, 20).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").start()
        )
        run.awaitTermination()
    return spark.read.schema(page_stream.OUT).parquet(f"{folder}/out").where("slug not like 'end%'")


query("page_sets_stream", ("v_page",), _pages_sql("total"))(
    lambda v: _streamed(v).where("page_offset is not null").select("slug", F.col("page_offset").cast("bigint").alias("page_offset"))
)

# --- merges without moving the snapshot ----------------------------------------------


def bucketed_merge(s: DataFrame, b: DataFrame) -> DataFrame:
    spark, name = s.sparkSession, "jobweir_" + _folder(s.sparkSession, "t").rpartition("-")[2]
    table = store.save_bucketed(s, name, _folder(spark, "bucketed"), ("k",), 16)
    return merge.upsert_jobs(table, b, _seq(), _at(), ("k",), _POLICY)


query(
    "upsert_bucketed", ("v_snap", "v_batch"),
    _LAST + """SELECT k, CASE WHEN b.k IS NOT NULL THEN b.title ELSE s.title END AS title, coalesce(b.description, s.description) AS description,
  coalesce(s.company_id, b.company_id) AS company_id, coalesce(status, 'new') AS status,
  CASE WHEN b.k IS NOT NULL AND s.k IS NOT NULL THEN 'known' WHEN b.k IS NOT NULL THEN 'new' END AS change
FROM v_snap s FULL JOIN b USING (k)""",
)(lambda s, b: bucketed_merge(s, b).select("k", "title", "description", "company_id", "status", "change"))

# --- ids of batches, one of them repeated -------------------------------------------
VIEWS["v_posted"] = """
SELECT CASE o_orderkey % 2 WHEN 0 THEN 'lever' ELSE 'ashbyhq' END AS ats_kind, 'e' || CAST(o_custkey * 10 + o_orderkey % 3 AS STRING) AS external_id, o_custkey AS company_id,
  'T' || CAST(o_orderkey AS STRING) AS title, o_orderkey AS seq, o_orderkey % 2 AS part FROM orders"""


def _batches(v: DataFrame) -> DataFrame:
    spark, root = v.sparkSession, _folder(v.sparkSession, "stream-jobs")
    rows = v.select("*", *[F.lit("x").alias(c) for c in ("location", "department", "apply_url", "posted_at", "raw_json", "description")]).withColumn(
        "remote", F.lit(None).cast("boolean")
    )
    run = stream_merge.apply_postings(root, F.col("seq"), lambda epoch: F.lit(f"2024-01-0{epoch + 1} 00:00:00").cast("timestamp"))
    for epoch, batch in ((0, rows.where("part = 0")), (1, rows), (1, rows)):
        run(batch.drop("part"), epoch)
    return store.read_table(spark, root, "jobs")


query(
    "stream_ids", ("v_posted",),
    """SELECT ats_kind, external_id, arg_max(title, seq) AS title, min(company_id) AS company_id, (SELECT count(*) FROM (SELECT DISTINCT ats_kind, external_id FROM v_posted)) AS last_id,
  TRUE AS dense, CASE WHEN bool_or(part = 0) THEN 1 ELSE 2 END AS first_day FROM v_posted GROUP BY ats_kind, external_id""",
)(
    lambda v: (lambda jobs: jobs.crossJoin(F.broadcast(jobs.agg(
        F.max("id").alias("last_id"), (F.count_distinct("id") == F.max("id")).alias("dense")
    ))).select("ats_kind", "external_id", "title", "company_id", "last_id", "dense", F.day("first_seen").alias("first_day")))(_batches(v))
)
query(
    "snapshot_round_trip", ("v_posted",),
    "SELECT row_number() OVER (ORDER BY seq) AS id, ats_kind, external_id, title FROM v_posted WHERE part = 0",
)(
    lambda v: _round_trip(listing.placed(v.where("part = 0"), F.col("seq")).withColumn("id", F.col("place") + 1)).select("id", "ats_kind", "external_id", "title")
)


def _round_trip(rows: DataFrame) -> DataFrame:
    spark, root = rows.sparkSession, _folder(rows.sparkSession, "snapshot")
    schema = spark.createDataFrame([], JOBS).schema
    filled = {"apply_url": F.lit("u"), "raw_json": F.lit("{}"), "status": F.lit("new"), "first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-01").cast("timestamp")}
    store.write_table(landed.conform(rows.withColumns(filled), schema).select(*schema.names), root, "jobs")
    return store.read_table(spark, root, "jobs")


# --- redirect chains -----------------------------------------------------------------
# Numbers are halved until they cannot be; every fiftieth leads to itself or back.
VIEWS["v_hop"] = """
SELECT 'u' || CAST(k AS STRING) AS url, 'u' || CAST(CASE WHEN k % 50 = 0 THEN k WHEN k % 50 = 25 THEN k + 1 WHEN k % 50 = 26 THEN k - 1 ELSE CAST(floor(k / 2) AS BIGINT) END AS STRING) AS next
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) WHERE k > 3"""
query(
    "redirect_ends", ("v_hop",),
    """WITH RECURSIVE w AS (SELECT url, next AS dest, 1 AS hops FROM v_hop UNION ALL SELECT w.url, h.next, hops + 1 FROM w JOIN v_hop h ON w.dest = h.url WHERE hops < 40),
e AS (SELECT url, arg_max(dest, hops) AS dest, max(hops) AS hops FROM w GROUP BY url)
SELECT url, CASE WHEN hops < 40 THEN dest END AS final_url, CASE WHEN hops < 40 THEN hops END AS hops, CASE WHEN hops = 40 THEN 'loop' WHEN hops > 9 THEN 'too long' ELSE 'ok' END AS outcome FROM e""",
)(lambda v: landed.redirect_ends(v, 9))

# --- health --------------------------------------------------------------------------
VIEWS["v_fails"] = "SELECT event_id AS run_id, event_type AS source, ts AS started_at, event_id % 3 = 0 OR event_id % 7 < 3 AS ok FROM events"
query(
    "failure_streaks", ("v_fails",),
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at, run_id) AS i FROM v_fails),
g AS (SELECT *, i - row_number() OVER (PARTITION BY source, ok ORDER BY i) AS island FROM n),
r AS (SELECT source, ok, island, count(*) AS len, max(i) AS last, min(started_at) AS began FROM g GROUP BY ALL), m AS (SELECT source, max(i) AS last FROM n GROUP BY source)
SELECT m.source, coalesce(max(len) FILTER (WHERE NOT ok AND r.last = m.last), 0) AS failing_for, coalesce(max(len) FILTER (WHERE NOT ok), 0) AS longest,
  max(began) FILTER (WHERE NOT ok AND r.last = m.last) AS since FROM m JOIN r ON m.source = r.source GROUP BY m.source""",
)(lambda v: reports.failure_streaks(v).withColumn("since", F.col("since").cast("timestamp_ntz")))
query(
    "daily_health", ("v_fails",),
    """WITH d AS (SELECT source, CAST(started_at AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok_runs FROM v_fails GROUP BY ALL)
SELECT *, round(sum(ok_runs) OVER w / sum(runs) OVER w, 9) AS share FROM d WINDOW w AS (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
)(lambda v: reports.daily_health(v).withColumn("share", F.round("share", 9)))

# --- deep pages ----------------------------------------------------------------------
VIEWS["v_deep"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS posted_at, o_custkey % 90 AS last_seen FROM orders"""
_ORDER = "posted_at NULLS LAST, last_seen DESC, id"


def _third_page(v: DataFrame) -> DataFrame:
    cursor = None
    for _ in range(3):
        page = written(listing.after(v, 500, cursor), "page")
        cursor = page.orderBy(F.col("posted_at").desc_nulls_first(), "last_seen", F.desc("id")).first()
        cursor = cursor and cursor.asDict()
    return page


query("list_after_cursor", ("v_deep",), f"SELECT * FROM v_deep ORDER BY {_ORDER} LIMIT 500 OFFSET 1000")(_third_page)
query("list_page_by_place", ("v_deep",), f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place FROM v_deep ORDER BY place LIMIT 700 OFFSET 8400")(
    lambda v: listing.page_at(listing.placed(v, F.col("posted_at").asc_nulls_last(), F.col("last_seen").desc(), F.col("id")), 12, 700)
)
query("companies_in_order", ("v_co",), "SELECT ats_kind, id, ats_slug, row_number() OVER (ORDER BY ats_kind, id) - 1 AS place FROM v_co")(
    lambda c: listing.placed(listing.by_kind(c).select("ats_kind", "id", "ats_slug"), F.col("ats_kind"), F.col("id"))
)
query(
    "orphan_discoveries", ("v_posted", "v_co"),
    "SELECT company_id, 'u' || seq AS source_url FROM v_posted WHERE company_id NOT IN (SELECT id FROM v_co WHERE id % 3 <> 0)",
)(
    lambda v, c: merge.orphans(v.select("company_id", F.concat(F.lit("u"), "seq").alias("source_url")), c.where("id % 3 <> 0")).select("company_id", "source_url")
)

# --- drift of payloads -----------------------------------------------------------------
# Lists of a day per two dozen customers; a field goes, one comes, one changes its type.
VIEWS["v_days"] = """
SELECT 'lever' AS kind, 's' || CAST(c_custkey AS STRING) AS slug, date_add(DATE '2024-01-01', CAST(c_custkey % 5 AS INT)) AS fetched_at, CASE WHEN c_custkey % 40 = 1 THEN 500 ELSE 200 END AS http_status, 0 AS page_offset,
  '[{"id":"' || CAST(c_custkey AS STRING) || '","text":"T","createdAt":' || CASE WHEN c_custkey % 5 >= 3 THEN '"' || CAST(c_custkey AS STRING) || '"' ELSE CAST(c_custkey AS STRING) END ||
  CASE WHEN c_custkey % 5 < 2 THEN ',"tags":["a"]' ELSE ',"team":{"n":null},"open":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'null' END END || '},{"id":7}]' AS body FROM customer"""
_TYPES = """e AS (SELECT kind, CAST(fetched_at AS DATE) AS day, unnest(from_json(body, '["JSON"]')) AS e FROM v_days WHERE http_status = 200),
k AS (SELECT kind, day, e, unnest(json_keys(e)) AS field FROM e),
t AS (SELECT kind, day, field, CASE json_type(e, '$.' || field) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'NULL' THEN 'VOID' ELSE json_type(e, '$.' || field) END AS type, count(*) AS n FROM k GROUP BY ALL)"""
query("field_types", ("v_days",), f"WITH {_TYPES} SELECT * FROM t")(landed.field_types)
query(
    "payload_drift", ("v_days",),
    f"""WITH {_TYPES}, s AS (SELECT kind, day, field, string_agg(type, ',' ORDER BY type) AS type FROM t WHERE type <> 'VOID' GROUP BY ALL),
d AS (SELECT kind, day, lag(day) OVER (PARTITION BY kind ORDER BY day) AS last FROM (SELECT DISTINCT kind, day FROM t)),
a AS (SELECT d.kind, d.day, field, type AS after FROM d JOIN s ON d.kind = s.kind AND d.day = s.day WHERE last IS NOT NULL),
b AS (SELECT d.kind, d.day, field, type AS before FROM d JOIN s ON d.kind = s.kind AND d.last = s.day)
SELECT kind, day, field, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'lost' ELSE 'retyped' END AS change, before, after
FROM a FULL JOIN b USING (kind, day, field) WHERE before IS DISTINCT FROM after""",
)(lambda v: landed.drift(landed.field_types(v)))
