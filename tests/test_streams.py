"""Streams: page sets in any order, ids of repeated batches, merges in place."""

import datetime as dt
import random

from pyspark.sql import functions as F

from jobweir.sources.landed import assemble_pages, run_outcomes
from jobweir.streaming import pages as ps

START = dt.datetime(2024, 1, 1)


def a_page(run, offset, status=200, n=2, total=6, minute=0, body=None):
    return ("smartrecruiters", f"s{run}", f"r{run}", START + dt.timedelta(minutes=minute), status, offset, n, total, body or f"{run}@{offset}")


def streamed(spark, tmp_path, batches, **options):
    folder = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ps.IN).coalesce(1).write.mode("append").parquet(f"{folder}/b{i:03d}")
    stream = spark.readStream.schema(ps.IN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = (
        ps.page_sets(stream, 2, **options).writeStream.format("memory").queryName("sets").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    query.stop()
    return spark.table("sets").collect()


def test_any_order_gives_the_pages_a_reader_keeps(spark, tmp_path):
    g = random.Random(2)
    runs = {
        1: [a_page(1, o) for o in (0, 2, 4)],
        2: [a_page(2, 0), a_page(2, 2, n=0), a_page(2, 4)],
        3: [a_page(3, 0), a_page(3, 2, status=500), a_page(3, 4)],
        4: [a_page(4, 0, status=404)],
        5: [a_page(5, 0, total=3), a_page(5, 2, total=3)],
        6: [a_page(6, 0), a_page(6, 2, status=404)],
    }
    all_ = [p for r in runs.values() for p in r]
    g.shuffle(all_)
    late = [a_page(1, 2, minute=1, body="again"), a_page(5, 2, total=3, minute=1, body="again")]
    # run 7 never ends: time passes through another run
    batches = [all_[:5], all_[5:], late, [a_page(7, 0)], [a_page(8, 0, total=2, minute=600)], [a_page(9, 0, total=2, minute=700)]]
    got = streamed(spark, tmp_path, batches)
    landed = spark.createDataFrame(all_, ps.IN)
    args = (landed, F.col("total"), F.col("n_entries"), 2, "each", ("kind", "slug"))
    want = {(r.slug, r.page_offset, r.body) for r in assemble_pages(*args).select("slug", "page_offset", "body").collect()}
    assert {(r.slug, r.page_offset, r.body) for r in got if r.page_offset is not None and r.slug < "s7"} == want
    outcomes = {r.slug: r.outcome for r in run_outcomes(*args).collect()}
    assert {r.slug: r.outcome for r in got if r.slug in outcomes} == outcomes
    assert {(r.outcome, r.closed_by, r.page_offset) for r in got if r.slug == "s7"} == {("ok", "timeout", 0)}


def test_verdicts_do_not_depend_on_what_lies_beyond():
    assert ps.verdict({}, 2, "each", False) is None
    assert ps.verdict({2: (200, 2, 6)}, 2, "each", False) is None
    assert ps.verdict({0: (200, 2, 6), 4: (500, 0, 0)}, 2, "each", False) is None
    assert ps.verdict({0: (200, 2, 0), 2: (200, 0, 0)}, 2, "first", False) == ("ok", "empty", [0])
    assert ps.verdict({0: (200, 2, 3), 2: (200, 2, 99)}, 2, "first", False) == ("ok", "total", [0, 2])
    assert ps.verdict({0: (200, 2, 6)}, 2, "each", True) == ("ok", "timeout", [0])


def posting(i, seq, kind="lever"):
    return (kind, f"e{i}", 5, f"T{seq}", None, None, "u", None, "{}", None, None, seq)


def test_a_repeated_batch_gives_the_same_ids(spark, tmp_path, monkeypatch):
    import pytest

    from jobweir.sources import store
    from jobweir.streaming import merge as sm

    schema = "ats_kind string, external_id string, company_id long, title string, location string, department string, apply_url string, posted_at string, raw_json string, description string, remote boolean, seq int"
    batch = lambda ids, seq: spark.createDataFrame([posting(i, seq) for i in ids], schema)
    root = f"file://{tmp_path}/state"
    run = sm.apply_postings(root, F.col("seq"), lambda epoch: F.lit(f"2024-01-0{epoch + 1}").cast("timestamp"))
    run(batch(range(20), 0), 0)
    # the second batch fails after its ids were written, then after its jobs were
    monkeypatch.setattr(sm, "write_table", lambda df, r, name: store.write_table(df, r, name) if name == "meta" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(batch(range(10, 40), 1), 1)
    monkeypatch.undo()
    run(batch(range(10, 40), 1), 1)
    once = {r.external_id: r.id for r in store.read_table(spark, root, "jobs").collect()}
    run(batch(range(10, 40), 1), 1)
    run(batch(range(35, 50), 2), 2)
    got = {r.external_id: r.id for r in store.read_table(spark, root, "jobs").collect()}
    assert once.items() <= got.items() and sorted(got.values()) == list(range(1, 51))
    meta = {r.key: r.value for r in store.read_table(spark, root, "meta").collect()}
    assert meta == {sm.LAST_ID: "50"}


def test_a_bucketed_snapshot_is_not_moved(spark, tmp_path):
    from jobweir.operators import merge
    from jobweir.sources import store

    snap = spark.range(200).select(F.col("id").alias("k"), F.lit("t").alias("title"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"), F.lit(None).cast("int").alias("closed_at"), F.lit("new").alias("status"))
    table = store.save_bucketed(snap, "snap_of_test", f"file://{tmp_path}/b", ("k",), 8)
    batch = spark.range(190, 210).select(F.col("id").alias("k"), F.lit("u").alias("title"), F.lit(0).alias("seq"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = merge.upsert_jobs(table, batch, F.col("seq"), F.lit(2), ("k",), {"title": "overwrite"})
        assert out.count() == 210 and out.where("title = 'u'").count() == 20
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE snap_of_test")
    left = plan[plan.index("SortMergeJoin") :].split("\n")
    scan = next(i for i, x in enumerate(left) if "snap_of_test" in x or "Bucketed: true" in x)
    assert not any("Exchange" in x for x in left[:scan])


def test_redirects_end_as_a_walk_does(spark):
    from jobweir.sources.landed import follow_redirects, redirect_ends

    g = random.Random(7)
    hops = {i: g.randrange(60) for i in range(45)} | {100 + i: 101 + i for i in range(30)}
    rows = [(f"u{a}", f"u{b}") for a, b in hops.items()]
    ends = redirect_ends(spark.createDataFrame(rows + [(None, "u1"), ("u2x", None)], "url string, next string"), 12)
    want = {}
    for a in hops:
        at, n = a, 0
        while at in hops and n <= len(hops):
            at, n = hops[at], n + 1
        loop = at in hops
        want[f"u{a}"] = (None, None, "loop") if loop else (f"u{at}", n, "too long" if n > 12 else "ok")
    assert {r.url: (r.final_url, r.hops, r.outcome) for r in ends.collect()} == want
    df = spark.createDataFrame([(f"u{i}",) for i in (*hops, 999)], "url string")
    got = {r.url: r.final_url for r in follow_redirects(df, ends).collect()}
    assert got == {u: e for u, (e, _, o) in want.items() if o == "ok"} | {"u999": "u999"}
    assert redirect_ends(spark.createDataFrame([], "url string, next string")).count() == 0


def test_runs_that_share_a_state_close_each_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ps, "GROUPS", 2)
    whole = [a_page(i, o) for i in range(100, 130) for o in (0, 2, 4)]
    # runs without an end, the later half of them 50 minutes on
    early, on = [a_page(i, 0) for i in range(200, 215)], [a_page(i, 0, minute=50) for i in range(215, 230)]
    again = [a_page(100, 0, minute=1, body="again")]  # closed by then
    times = [[a_page(900 + i, 0, total=2, minute=m)] for i, m in enumerate((70, 71, 600, 601))]
    got = streamed(spark, tmp_path, [whole[::2] + early, whole[1::2] + on, again, *times])
    assert sorted((r.slug, r.page_offset) for r in got if "s100" <= r.slug < "s130") == sorted((p[1], p[5]) for p in whole)
    assert not [r for r in got if r.body == "again"]
    assert {r.slug: (r.outcome, r.closed_by) for r in got if "s200" <= r.slug < "s230"} == {f"s{i}": ("ok", "timeout") for i in range(200, 230)}
    assert {r.slug for r in got if r.slug >= "s900"} == {f"s{900 + i}" for i in range(4)}
