"""Pages, snapshots, streams."""

from pyspark.sql import functions as F

from jobweir.schemas import JOBS
import glob
import os

from jobweir.sources import adapters, landed, store
from jobweir.streaming.merge import apply_postings


def pages(spark, rows):
    df = spark.createDataFrame(rows, "kind string, slug string, page_offset int, http_status int, n int, total int")
    return df


def kept(df, how):
    out = landed.assemble_pages(df, F.col("total"), F.col("n"), 20, how)
    return sorted((r.slug, r.page_offset) for r in out.collect())


def test_pages(spark):
    df = pages(
        spark,
        [
            ("k", "a", 0, 200, 20, 45), ("k", "a", 20, 200, 20, 0), ("k", "a", 40, 200, 5, 0),
            ("k", "b", 0, 200, 20, 45), ("k", "b", 20, 500, 0, None),
            ("k", "c", 0, 404, 0, None), ("k", "d", 0, 200, 20, 90), ("k", "d", 20, 404, 0, None), ("k", "d", 40, 200, 20, 90),
        ],
    )
    assert kept(df, "first") == [("a", 0), ("a", 20), ("a", 40), ("d", 0)]
    assert kept(df, "each") == [("a", 0), ("a", 20), ("d", 0)]
    outcome = {r.slug: r.outcome for r in landed.run_outcomes(df, F.col("total"), F.col("n"), 20, "first").collect()}
    assert outcome == {"a": "ok", "b": "failed", "c": "stale", "d": "ok"}


def test_bad_entries_are_dropped(spark):
    body = '{"jobs":[{"id":7,"title":"A","absolute_url":"u","x":1},{"id":8,"title":null,"absolute_url":"u"},"s",{"id":9,"title":"B","absolute_url":"u","offices":5}]}'
    rows = [("greenhouse", "a", None, 200, 0, body), ("greenhouse", "b", None, 200, 0, "{}"), ("greenhouse", "c", None, 200, 0, None)]
    df = spark.createDataFrame(rows, "kind string, slug string, fetched_at timestamp, http_status int, page_offset int, body string")
    got = adapters.NORMALISERS["greenhouse"](df).collect()
    assert [(r.external_id, r.remote, r.raw_json) for r in got] == [("7", False, '{"absolute_url":"u","id":7,"title":"A","x":1}')]


def test_snapshots_and_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert store.read_table(spark, root, "jobs").isEmpty()
    batch = spark.createDataFrame(
        [("lever", "1", 5, "A", 0), ("lever", "2", 5, "B", 1)],
        "ats_kind string, external_id string, company_id long, title string, seq int",
    )
    for c in ("location", "department", "apply_url", "posted_at", "raw_json", "description"):
        batch = batch.withColumn(c, F.lit("x"))
    batch = batch.withColumn("remote", F.lit(None).cast("boolean"))
    run = apply_postings(root, F.col("seq"), lambda epoch: F.lit(f"2024-01-0{epoch + 1} 00:00:00").cast("timestamp"))
    run(batch, 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/jobs/*/*/*.parquet")}
    run(batch.where("external_id = '2'").withColumn("title", F.lit("C")), 1)
    got = {r.external_id: r for r in store.read_table(spark, root, "jobs").collect()}
    assert got["2"].title == "C" and got["1"].title == "A" and got["2"].last_seen > got["1"].last_seen
    assert sorted(r.id for r in got.values()) == [1, 2]
    # only the partition of the second batch was written again
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/jobs/*/*/*.parquet")}
    assert len(before) == len(after) == 2 and len(before.items() & after.items()) == 1
    try:
        store.write_table(spark.createDataFrame([], JOBS).union(store.read_table(spark, root, "jobs").withColumn("title", F.lit(None).cast("string"))), root, "jobs")
        raise AssertionError
    except ValueError:
        pass


def test_tags_are_worked_out_once(spark):
    from jobweir.plans import pipelines

    feed = spark.sql("SELECT 's' AS source, concat('<item><title>a at b</title><link>https://jobs.lever.co/x/1</link></item>', cast(id AS string)) AS body FROM range(1)")
    plan = pipelines.structured_rss(feed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title>") <= 3 and plan.count("</description>") <= 3
    assert pipelines.structured_rss(feed).select("title", "ats_kind").first()[:] == ("a at b", "lever")


def test_narrow_tables_are_dealt_to_all_tasks(spark):
    from jobweir import driver

    for name in ("v_feed", "v_lever", "v_pair"):
        assert driver.view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() > 1


def test_loops_end_with_their_length(spark, monkeypatch):
    from jobweir.sources import landed

    # loops of 1, 2, 3 and 5 with tails, among many chains of one hop
    hops = [(f"c{n}_{i}", f"c{n}_{(i + 1) % n}") for n in (1, 2, 3, 5) for i in range(n)]
    hops += [(f"{t}{n}_{i}", f"{t}{n}_{i + 1}" if i < 3 else f"c{n}_0") for t in ("a", "z") for n in (1, 2, 3, 5) for i in range(4)]
    hops += [(f"m{i}", f"end{i}") for i in range(3000)] + [(f"l{i:02}", f"l{i + 1:02}") for i in range(12)]
    rounds, write = [], landed.written
    monkeypatch.setattr(landed, "written", lambda df, name: rounds.append(name) or write(df, name))
    got = {r.url: r for r in landed.redirect_ends(spark.createDataFrame(hops, "url string, next string"), 9).collect()}
    assert len(got) == len(hops)
    assert {u for u, r in got.items() if r.outcome == "loop"} == {u for u, _ in hops if u[0] in "caz"}
    assert (got["l00"].outcome, got["l00"].final_url, got["l00"].hops) == ("too long", "l12", 12)
    assert (got["m7"].outcome, got["m7"].final_url, got["m7"].hops, got["l05"].outcome) == ("ok", "end7", 1, "ok")
    assert len(rounds) <= 7


def test_a_partitioned_write_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    jobs = spark.createDataFrame([], JOBS).schema
    text = {c.name: F.lit("x") for c in jobs if c.dataType.simpleString() == "string"}
    rows = spark.range(20).withColumns(text | {"external_id": F.col("id").cast("string"), "company_id": F.col("id")})
    rows = landed.conform(rows.withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("first_seen", "last_seen")}), jobs)
    store.write_table(rows.select(*jobs.names).mapInArrow(count, jobs), f"file://{tmp_path}", "jobs")
    assert seen.value == 20 and store.read_table(spark, f"file://{tmp_path}", "jobs").count() == 20


def test_entries_are_read_once(spark):
    from jobweir.sources import adapters

    body = '[{"id":"1","text":" A "},{"text":"no id"},{"id":[2],"text":"B"},7,null]'
    schema = "kind string, slug string, fetched_at int, page_offset int, body string"
    landed = spark.createDataFrame([("lever", "s", 1, 0, body), ("lever", "s", 2, 0, None)], schema)
    for got in (adapters.normalise(landed), adapters.NORMALISERS["lever"](landed)):
        assert "1" in {r.external_id for r in got.collect()}
        # a filter that reads JSON works out again what the fields below it read
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if x.strip(" :+-").startswith("Filter") and "from_json" in x]
