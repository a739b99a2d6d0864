"""The pipeline: each stage's decisions hold on its own input."""

import math
from collections import Counter, defaultdict

import corpus_pipeline as cp
from jobweir.llm import quality_gam
from test_lines import plain as plain_lines
from test_near import shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    items = {r.item_id: set(shingles(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    ins = []
    for k, (name, stage) in enumerate(cp.STAGES):
        ins.append(docs)
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    tables = [{r.doc_id: r for r in d.collect()} for d in (*ins, docs)][:5]
    start, good, cut, single, clean = tables
    assert 0 < len(good) < len(start)
    model = quality_gam.train(ins[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_gam.scored(ins[0], model).collect()}
    assert set(good) == {i for i, s in scores.items() if s >= 0.5}

    want = plain_lines([(i, r.text) for i, r in good.items()])
    assert sorted((i, r.text) for i, r in cut.items()) == sorted((i, t) for i, t, _, _ in want)
    assert all(r.n_chars == len(r.text) for r in cut.values())

    sets = {i: shingles(r.text) for i, r in cut.items()}
    near = defaultdict(set)
    for i in cut:
        for j in cut:
            both = sum((sets[i] & sets[j]).values())
            either = sum((sets[i] | sets[j]).values())
            if i < j and either and both >= 0.85 * either:
                near[i].add(j)
    # of each pair that is near without a doubt at most one is left, and no one goes alone
    assert not any(i in single and j in single for i, js in near.items() for j in js)
    gone = set(cut) - set(single)
    alike = {j for i in cut for j in cut if i < j and cut[i].text == cut[j].text} | {
        j for i in cut for j in cut if i != j and sum((sets[i] & sets[j]).values()) >= 0.7 * max(1, sum((sets[i] | sets[j]).values()))
    }
    assert gone <= alike

    held = {i for i, s in sets.items() if any(q and len(q & set(s)) >= 0.8 * len(q) for q in items.values())}
    assert set(clean) == {i for i in single if i not in held}

    rows = docs.collect()
    assert Counter(r.doc_id for r in rows).keys() == clean.keys()
    n = len({r.sequence_id for r in rows})
    bound = math.ceil(sum(r.length for r in rows) / 1024)
    assert bound <= n <= bound + max(2, bound // 50)


def test_stage_on_no_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0).select(*cp.COLUMNS)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).collect() == [], name


def test_null_and_repeated_ids(spark):
    """Rows without an id, rows that repeat one, null and very long texts."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).where("n_chars > 400").orderBy("doc_id").limit(6).collect()
    texts = [r.text for r in real]
    rows = [
        (1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (3, None), (4, ""),
        (5, " ".join(texts) * 30), (6, texts[3]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF).collect()
        ids = [r.doc_id for r in out]
        if name == "near_dedup":
            assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(
                [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (3, None), (5, rows[8][1]), (6, texts[3])], key=repr
            )
        elif name == "line_dedup":
            assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in rows) and all(r.text is not None for r in out)
        elif name == "packing":
            assert Counter(ids).keys() == {1, 2, 3, 4, 5, 6, None} and sum(i == 1 for i in ids) >= 3
        else:
            assert set(ids) <= {i for i, _ in rows}
