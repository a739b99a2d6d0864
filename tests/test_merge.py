"""Merges against a fold over the batch, one row after the other."""

import random

from pyspark.sql import functions as F

from jobweir.operators import merge

POLICY = {"title": "overwrite", "description": "coalesce", "company_id": "keep"}
SNAP = "k int, title string, description string, company_id int, first_seen int, last_seen int, closed_at int, status string"
BATCH = "k int, title string, description string, company_id int, seq int"


def fold(snapshot, batch, now):
    state = {r[0]: list(r) for r in snapshot}
    for k, title, description, company, _ in sorted(batch, key=lambda r: r[4]):
        old = state.get(k)
        if old is None:
            state[k] = [k, title, description, company, now, now, None, "new"]
        else:
            keep = description if description is not None else old[2]
            state[k] = [k, title, keep, old[3], old[4], now, None, old[7]]
    return sorted(map(tuple, state.values()))


def random_case(seed):
    g = random.Random(seed)
    word = lambda: g.choice([None, "a", "b", "c"])
    snap = [(k, word(), word(), g.randint(1, 3), 1, g.randint(1, 5), g.choice([None, 4]), "applied") for k in range(8)]
    batch = [(g.randint(0, 14), word(), word(), g.randint(1, 9), i) for i in range(20)]
    return snap, batch


def upsert(spark, snap, batch, now):
    s, b = spark.createDataFrame(snap, SNAP), spark.createDataFrame(batch, BATCH)
    return merge.upsert_jobs(s, b, F.col("seq"), F.lit(now), ("k",), POLICY)


def rows(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in SNAP.split(", ")]).collect()))


def test_upsert_is_the_fold(spark):
    for seed in range(4):
        snap, batch = random_case(seed)
        assert rows(upsert(spark, snap, batch, 9)) == fold(snap, batch, 9)


def test_twice_changes_last_seen_only(spark):
    snap, batch = random_case(11)
    once = rows(upsert(spark, snap, batch, 9))
    twice = rows(upsert(spark, once, batch, 10))
    seen = {b[0] for b in batch}
    assert [r[:5] + r[6:] for r in once] == [r[:5] + r[6:] for r in twice]
    assert all(b[5] == (10 if b[0] in seen else a[5]) for a, b in zip(once, twice))


def test_empty_sides(spark):
    snap, batch = random_case(3)
    assert rows(upsert(spark, snap, [], 9)) == sorted(snap)
    assert rows(upsert(spark, [], batch, 9)) == fold([], batch, 9)


def test_sweep_touches_synced_companies_only(spark):
    jobs = spark.createDataFrame(
        [(1, "a", 1, None), (1, "a", 5, None), (1, "b", 1, None), (2, "a", 1, None), (1, "a", 1, 2)],
        "company_id int, ats_kind string, last_seen int, closed_at int",
    )
    synced = spark.createDataFrame([(1, "a", 5)], "company_id int, ats_kind string, started_at int")
    got = [tuple(r) for r in merge.sweep(jobs, synced, F.lit(9)).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "a", 1, 9), (1, "a", 5, None), (1, "b", 1, None), (2, "a", 1, None), (1, "a", 1, 2)], key=repr
    )


def test_marks(spark):
    assert merge.parse_ids("1, 2,,3") == [1, 2, 3]
    try:
        merge.parse_ids("1,x")
        raise AssertionError
    except ValueError:
        pass


def test_ids_have_no_gaps(spark):
    df = spark.range(100).select((F.col("id") * 7).alias("k"))
    got = merge.assign_ids(df, 50, ["k"], F.col("k") % 5).collect()
    assert sorted(r.id for r in got) == list(range(51, 151))


def test_selectors_meet_all_companies(spark):
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    customers = spark.read.parquet(f"{d}/customer.parquet").count()
    got = e.queries()["resolve_selector_all"](spark, d)
    assert got.count() == customers and got.agg(F.max("company_id")).first()[0] > 120
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == {"none", "one", "many"}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet'")
        want = db.execute(e.oracle_sql()["resolve_selector_all"]).fetchall()
    assert sorted(map(tuple, got.select("selector", "outcome", "company_id", "matches").collect())) == sorted(want)


def test_repeated_marks_and_companies_keep_one_row_a_job(spark):
    jobs = spark.createDataFrame(
        [(1, 5, "lever", "new", None, None, 1, None), (2, 5, "lever", "new", None, None, 9, None)],
        "id int, company_id int, ats_kind string, status string, status_changed_at int, status_note string, last_seen int, closed_at int",
    )
    marks = spark.createDataFrame([(1, "applied", "a", 1), (1, "dismissed", "b", 2), (1, "applied", "c", 0)], "id int, status string, note string, seq int")
    got = sorted(tuple(r) for r in merge.mark(jobs, marks, F.lit(7), F.col("seq")).select("id", "status", "status_note").collect())
    assert got == [(1, "dismissed", "b"), (2, "new", None)]
    assert merge.mark(jobs, marks, F.lit(7)).count() == 2
    synced = spark.createDataFrame([(5, "lever", 3), (5, "lever", 4)], "company_id int, ats_kind string, started_at int")
    got = sorted(tuple(r) for r in merge.sweep(jobs, synced, F.lit(7)).select("id", "closed_at").collect())
    assert got == [(1, 7), (2, None)]


LANDED = "kind string, slug string, fetched_at int, http_status int, page_offset int, body string"


def a_list(*ids):
    return "[" + ",".join(f'{{"id":"{i}","text":"T {i}"}}' for i in ids) + "]"


def a_page(total, *ids):
    return f'{{"totalFound":{total},"content":[' + ",".join(f'{{"id":"{i}","name":"N"}}' for i in ids) + "]}"


def test_syncs_merge_no_failed_company_and_heed_retries(spark):
    landed = [
        ("lever", "mended", 1, 500, 0, None), ("lever", "mended", 6, 200, 0, a_list("m")),
        ("lever", "broken", 1, 200, 0, a_list("x")), ("lever", "broken", 6, 500, 0, None),
        ("lever", "twice", 1, 200, 0, a_list("t", "gone")), ("lever", "twice", 6, 200, None, a_list("t")),
        ("lever", "empty", 1, 200, 0, "[]"), ("lever", "stranger", 1, 200, 0, a_list("s")), ("lever", "lost", 1, 404, 0, None),
        ("smartrecruiters", "paged", 1, 200, 0, a_page(150, "p")), ("smartrecruiters", "paged", 1, 500, 100, None),
        ("smartrecruiters", "paged", 2, 200, 100, a_page(150, "q")), ("smartrecruiters", "paged", 1, 500, 200, None),
        ("smartrecruiters", "half", 1, 200, 0, a_page(150, "h")), ("smartrecruiters", "half", 1, 500, 100, None),
    ]
    slugs = sorted({r[1] for r in landed} - {"stranger"})
    kinds = {r[1]: r[0] for r in landed}
    firms = spark.createDataFrame([(i, kinds[s], s) for i, s in enumerate(slugs)], "id long, ats_kind string, ats_slug string")
    old = [(7 + i, i, kinds[s], f"old-{s}", "T", 0, None, "applied") for i, s in enumerate(slugs)]
    old[0] = old[0][:3] + ("m",) + old[0][4:]  # a known job of another company under the same id
    jobs = spark.createDataFrame(old, "id long, company_id long, ats_kind string, external_id string, title string, last_seen int, closed_at int, status string")
    for c in ("location", "department", "apply_url", "description", "posted_at", "raw_json"):
        jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    jobs = jobs.withColumns({"remote": F.lit(None).cast("boolean"), "first_seen": F.lit(0)})
    from jobweir.plans import sync

    got = sync.sync(spark.createDataFrame(landed, LANDED), firms, jobs, F.lit(9))
    rows = {r.external_id: r for r in got.jobs.collect()}
    assert len(rows) == len(old) + 3 and {k for k, r in rows.items() if r.change == "new"} == {"t", "p", "q"}
    assert sorted(r.id for r in rows.values()) == list(range(7, 7 + len(rows)))
    closed = {k for k, r in rows.items() if r.closed_at}
    assert closed == {f"old-{s}" for s in ("mended", "twice", "empty", "paged")} - {f"old-{slugs[0]}"}
    report = {r.kind: r for r in got.report.collect()}
    assert (report["lever"].companies_synced, report["lever"].companies_404, report["lever"].jobs_seen) == (3, 1, 2)
    assert (report["smartrecruiters"].companies_synced, report["smartrecruiters"].jobs_new) == (1, 2)
    assert {r.source: r.items_new for r in got.runs.collect()} == {"sync:lever": 1, "sync:smartrecruiters": 2}


def test_numbers_have_no_gaps(spark):
    from jobweir.operators import merge as m

    got = m.numbered(spark.range(1000).repartition(7).withColumnRenamed("id", "k"), 50)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(51, 1051)) and len({r.k for r in rows}) == 1000
    assert rows == got.collect() and m.numbered(spark.range(0).withColumnRenamed("id", "k"), 5).collect() == []


def test_a_sync_report_works_the_merge_out_once(spark):
    from jobweir.plans import sync

    landed = spark.createDataFrame([("lever", "s", 1, 200, 0, a_list("a", "b"))], LANDED)
    firms = spark.createDataFrame([(1, "lever", "s")], "id long, ats_kind string, ats_slug string")
    jobs = spark.createDataFrame([(i, 1, "lever", k, 0, c) for i, k, c in ((4, "b", None), (5, "z", None), (6, "y", 0))],
        "id long, company_id long, ats_kind string, external_id string, last_seen int, closed_at int")
    for c in ("title", "location", "department", "apply_url", "description", "posted_at", "raw_json", "status"):
        jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    got = sync.sync(landed, firms, jobs.withColumns({"remote": F.lit(None).cast("boolean"), "first_seen": F.lit(0)}), F.lit(9)).report
    assert [tuple(r) for r in got.collect()] == [("lever", 1, 0, 2, 1, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 1
