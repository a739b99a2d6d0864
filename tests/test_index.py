"""The index of match data is worked out once, by either way of its join."""

import random

from pyspark.sql import functions as F

from jobweir.operators import textindex as ti

ROW = "id long, title string, location string, department string, description string"
WORDS = ["rust", "zig", "Łódź", "go", "x"]


def jobs(spark, g, ids):
    text = lambda n: " ".join(g.choices(WORDS, k=g.randint(0, n)))
    return spark.createDataFrame([(i, text(3), None, text(1), text(9)) for i in ids], ROW)


def test_a_changed_index_is_read_without_joins_or_texts(spark, monkeypatch):
    g = random.Random(4)
    before, edits = jobs(spark, g, range(80)), jobs(spark, g, range(60, 110, 2))
    gone = spark.createDataFrame([(i,) for i in (3, 3, 70, 102, 500)], "id long")
    old = ti.entries(before)
    found = []
    for sent in (0, 1000):
        monkeypatch.setattr(ti, "SENT", sent, raising=False)
        new = ti.changed(old, edits, gone)
        for df in new:
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "regexp_extract_all" not in plan
        found.append((sorted(new.index.collect()), sorted(new.delta.collect())))
    assert found[0] == found[1]
    ids = [r.id for r in found[0][0]]
    assert ids == sorted((set(range(80)) | set(range(60, 110, 2))) - {3, 70, 102})
    want = sorted(ti.statistics(new.index).collect())
    assert sorted(ti.added(ti.statistics(old), new.delta).collect()) == want


def test_bounds_of_some_words_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 7)
    index = ti.entries(jobs(spark, random.Random(5), range(50)))
    words = ["rust", "łodz", "none"]
    few = ti.bounds(index, words)
    assert sorted(few.collect()) == sorted(ti.bounds(index).where(F.col("term").isin(words)).collect())
    # rows of one block meet; those of one job need not
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
