"""State merges: snapshot and batch in, next snapshot out.

``now`` and other times are arguments, so a merge can be repeated. A snapshot
is joined to the reduced batch once, by a full outer join on the key; a
snapshot bucketed by that key needs no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written

JOB_KEY = ("ats_kind", "external_id")
#: What a batch does to a known job: take its value, keep the old one where the
#: batch has none, or keep the old one always.
JOB_POLICY = {
    "title": "overwrite", "location": "overwrite", "department": "overwrite",
    "apply_url": "overwrite", "posted_at": "overwrite", "raw_json": "overwrite",
    "description": "coalesce", "remote": "coalesce", "company_id": "keep",
}


def last_write(batch: DataFrame, key, policy: dict[str, str], seq: Column) -> DataFrame:
    """One row a key: what writing the batch's rows one by one, in seq order, leaves.

    seq must be unique within a key.
    """
    over = [c for c, p in policy.items() if p == "overwrite"]
    aggs = [F.count(F.lit(1)).alias("_seen")]
    if over:
        aggs.append(F.max_by(F.struct(*over), seq).alias("_last"))
    for c, p in policy.items():
        if p == "coalesce":
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c))
        elif p == "keep":
            aggs.append(F.min_by(F.col(c), seq).alias(c))
    out = batch.groupBy(*key).agg(*aggs)
    return out.withColumns({c: F.col("_last")[c] for c in over}).drop("_last")


def merged(
    snapshot: DataFrame, batch: DataFrame, key, policy: dict[str, str], seq: Column, now: Column
) -> DataFrame:
    """Key, policy columns, first_seen, last_seen, the snapshot's other columns,
    and change: "new", "known" or null. New rows have null in the others."""
    new = last_write(batch, key, policy, seq).withColumn("_hit", F.lit(True))
    others = [c for c in snapshot.columns if c not in (*key, *policy, "first_seen", "last_seen")]
    s, b = snapshot.withColumn("_was", F.lit(True)).alias("s"), new.alias("b")
    hit = F.col("b._hit").isNotNull()
    was = F.col("s._was").isNotNull()
    value = {
        "overwrite": lambda c: F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")),
        "coalesce": lambda c: F.coalesce(f"b.{c}", f"s.{c}"),
        "keep": lambda c: F.when(was, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")),
    }
    return s.join(b, list(key), "full_outer").select(
        *key,
        *[value[p](c).alias(c) for c, p in policy.items()],
        F.when(was, F.col("s.first_seen")).otherwise(now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("s.last_seen")).alias("last_seen"),
        *[F.col(f"s.{c}") for c in others],
        F.when(hit & was, "known").when(hit, "new").alias("change"),
    )


def upsert_jobs(
    jobs: DataFrame,
    batch: DataFrame,
    seq: Column,
    now: Column,
    key=JOB_KEY,
    policy: dict[str, str] | None = None,
) -> DataFrame:
    """jobs with the batch merged in, and change. A job that is seen is open
    again; status stays; new jobs have status "new" and a null id (assign_ids)."""
    out = merged(jobs, batch, key, policy or JOB_POLICY, seq, now)
    out = out.withColumn("status", F.coalesce("status", F.lit("new")))
    return out.withColumn("closed_at", F.when(F.col("change").isNull(), F.col("closed_at")))


def upsert_companies(
    companies: DataFrame, batch: DataFrame, seq: Column, now: Column
) -> DataFrame:
    """companies with a batch (ats_kind, ats_slug, name_hint) merged in, and
    change; the last hint names a company, its slug if none ever did."""
    known = companies.withColumnRenamed("name", "name_hint")
    out = merged(known, batch, ("ats_kind", "ats_slug"), {"name_hint": "coalesce"}, seq, now)
    return out.withColumn("name", F.coalesce("name_hint", "ats_slug")).drop("name_hint")


def sweep(jobs: DataFrame, synced: DataFrame, now: Column) -> DataFrame:
    """jobs with those closed that a successful sync did not see.

    synced has (company_id, ats_kind, started_at) of each company whose fetch
    succeeded, also if it was empty; others are not touched. Of rows that repeat
    a company the latest start counts.
    """
    gone = F.col("closed_at").isNull() & (F.col("last_seen") < F.col("_started"))
    s = synced.groupBy("company_id", "ats_kind").agg(F.max("started_at").alias("_started"))
    return (
        jobs.join(s, ["company_id", "ats_kind"], "left")
        .withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at")))
        .select(*jobs.columns)
    )


def assign_ids(new: DataFrame, start: int, order: list[str], block: Column) -> DataFrame:
    """new with id: start + 1, start + 2, ... over blocks and, in them, by order.

    No window sees all rows: blocks are numbered apart, and a running sum over
    their counts gives each its base. block must depend on the row alone.
    """
    rows = new.withColumn("_block", block)
    base = (
        rows.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_base",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return (
        rows.withColumn("_place", place)
        .join(F.broadcast(base), "_block")
        .withColumn("id", F.col("_base") + F.col("_place") + F.lit(start))
        .drop("_block", "_base", "_place")
    )


def numbered(new: DataFrame, start: int, name: str = "id") -> DataFrame:
    """new with id (or name): start + 1, start + 2, ... without a gap.

    The rows are written first; a row's number is its place in its file and the
    rows of the files before it, so no window sees them, none is read twice for
    it, and what was numbered once stays so when a later task is repeated.
    """
    rows = written(new.drop(name), "numbered").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_file", F.coalesce(F.sum("_n").over(files), F.lit(0)).alias("_base"))
    id_ = (F.lit(start + 1) + F.col("_base") + F.col("_row")).cast("bigint")
    return rows.join(F.broadcast(base), "_file").withColumn(name, id_).drop("_file", "_row", "_base")


def discoveries(batch: DataFrame, companies: DataFrame, via: Column, now: Column) -> DataFrame:
    """Log rows: one for each sighting of a batch, new company or not."""
    ids = companies.select(F.col("id").alias("company_id"), "ats_kind", "ats_slug")
    return batch.join(ids, ["ats_kind", "ats_slug"]).select(
        "company_id", via.alias("discovered_via"), now.alias("discovered_at"), "source_url"
    )


def orphans(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows whose company_id has no company."""
    return rows.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_anti")


def new_keys(batch: DataFrame, snapshot: DataFrame, key) -> DataFrame:
    return batch.select(*key).distinct().join(snapshot.select(*key), list(key), "left_anti")


def only_for(rows: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Rows of the given keys: follow-up work for what has just been inserted."""
    return rows.join(keys.select(*key).distinct(), list(key), "left_semi")


# --- status -----------------------------------------------------------------

STATUSES = {"new": "new", "reset": "new", "applied": "applied", "dismissed": "dismissed"}


def parse_ids(text: str) -> list[int]:
    """Ids of a comma list; blanks are dropped, anything else rejects the list."""
    return [int(x) for x in (p.strip() for p in text.split(",")) if x]


def mark(jobs: DataFrame, marks: DataFrame, now: Column, seq: Column | None = None) -> DataFrame:
    """jobs with the status and note of marks (id, status, note). Of marks that
    repeat an id the last by seq counts; without a seq, the greatest."""
    order = F.struct("status", "note") if seq is None else F.struct(seq, "status", "note")
    m = marks.groupBy("id").agg(F.max_by(F.struct("status", "note"), order).alias("m")).select(
        "id", F.col("m.status").alias("_status"), F.col("m.note").alias("_note")
    )
    hit = F.col("_status").isNotNull()
    status = F.when(F.col("_status") == "reset", "new").otherwise(F.col("_status"))
    return (
        jobs.join(m, "id", "left")
        .withColumns(
            {
                "status": F.when(hit, status).otherwise(F.col("status")),
                "status_changed_at": F.when(hit, now).otherwise(F.col("status_changed_at")),
                "status_note": F.when(hit, F.col("_note")).otherwise(F.col("status_note")),
            }
        )
        .select(*jobs.columns)
    )


def mark_failures(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    return marks.join(jobs.select("id"), "id", "left_anti")


def mark_company(jobs: DataFrame, company_ids: DataFrame, status: str, note: str | None, now: Column) -> DataFrame:
    """jobs with a status for all open jobs of companies (company_id)."""
    chosen = company_ids.select("company_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull() & F.col("closed_at").isNull()
    return (
        jobs.join(chosen, "company_id", "left")
        .withColumns(
            {
                "status": F.when(hit, F.lit(STATUSES[status])).otherwise(F.col("status")),
                "status_changed_at": F.when(hit, now).otherwise(F.col("status_changed_at")),
                "status_note": F.when(hit, F.lit(note)).otherwise(F.col("status_note")),
            }
        )
        .select(*jobs.columns)
    )


def resolve_selectors(selectors: DataFrame, companies: DataFrame) -> DataFrame:
    """(selector, outcome, company_id, matches) of selectors company:[kind/]slug.

    outcome is "none", "one" or "many"; a slug with a slash needs its kind.
    """
    rest = F.substring(F.col("selector"), F.lit(9), F.char_length("selector"))
    cut = F.contains(rest, F.lit("/"))
    kind = F.when(cut, F.substring_index(rest, "/", 1))
    slug = F.when(cut, F.regexp_replace(rest, "^[^/]*/", "")).otherwise(rest)
    s = selectors.select("selector", kind.alias("_kind"), slug.alias("_slug"))
    c = companies.select("id", "ats_kind", "ats_slug")
    same = (F.col("_slug") == F.col("ats_slug")) & (F.col("_kind").isNull() | (F.col("_kind") == F.col("ats_kind")))
    found = F.count("id")
    return s.join(c, same, "left").groupBy("selector").agg(
        F.when(found == 0, "none").when(found == 1, "one").otherwise("many").alias("outcome"),
        F.when(found == 1, F.min("id")).alias("company_id"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "ats_kind", "ats_slug"))), ",").alias("matches"),
    )


def put_meta(meta: DataFrame, batch: DataFrame, seq: Column) -> DataFrame:
    """Key/value upsert: the last value of a key wins."""
    new = last_write(batch, ("key",), {"value": "overwrite"}, seq).select(
        "key", F.col("value").alias("_new"), F.lit(True).alias("_hit")
    )
    return meta.join(new, "key", "full_outer").select(
        "key", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")).alias("value")
    )


def run_row(report: DataFrame, source: Column, started: Column, finished: Column, ok: Column,
            seen: Column, new: Column, http_status: Column | None = None, error: Column | None = None) -> DataFrame:
    """Finished rows for the run log from a report."""
    return report.select(
        source.alias("source"),
        started.alias("started_at"),
        finished.alias("finished_at"),
        ok.alias("ok"),
        (F.lit(None) if http_status is None else http_status).cast("int").alias("http_status"),
        seen.cast("bigint").alias("items_seen"),
        new.cast("bigint").alias("items_new"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )
