import collections
import re

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_and_run_equals_them(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DIR), "test")
        assert set(docs.columns) == set(columns)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) >= len(ids[3]) == len(ids[4])
    assert not any(re.search(r"[a-z]@[a-z]", r.text or "") for r in docs.select("text").collect())
    last = collections.Counter(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()))
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == last


def test_rows_without_or_with_a_shared_id(spark, tmp_path):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    bench = " ".join(f"b{i}" for i in range(30))
    rows = [(None, say(1)), (None, say(1)), (7, say(1)), (8, say(2)), (8, say(2)), (8, say(3)), (9, say(3)), (None, bench), (8, bench + " more"), (5, None), (5, None), (6, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], columns)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = collections.Counter((r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect())
    alike = [k for k in got if (k[1] or "").startswith("b0")]  # linked by 26 of 27 shingles: one of the two
    assert len(alike) == 1 and got.pop(alike[0]) == 1
    assert got == collections.Counter([(7, say(1)), (8, say(2)), (9, say(3)), (6, ""), (5, None)])
    kept = stages["decontaminate"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, [r for r in rows if not (r[1] or "").startswith("b0")]))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
