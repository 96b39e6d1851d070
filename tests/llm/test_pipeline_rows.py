import random

import corpus_pipeline
from tests.llm.test_pipeline import fixture

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_stages_decide_for_each_text_not_for_each_id(spark, tmp_path):
    docs, labels, bench = fixture()
    rng = random.Random(1)
    clean = [" ".join(f"{rng.choice('bcdfg')}a{rng.choice('lmnr')}o{i}x{j}" for j in range(40)) for i in range(6)]
    toxic, leaked = docs[0][1], clean[5] + " " + bench[0][1]
    # Clean rows beside bad rows, without an id and under one id.
    odd = [(None, clean[0]), (None, clean[1]), (None, toxic), (None, leaked), (7000, clean[2]), (7000, clean[3]), (7000, toxic), (7000, leaked), (7000, clean[2]), (None, clean[4]), (None, clean[4] + " tail"), (8000, clean[4])]
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in odd]
    frame = spark.createDataFrame(docs + rows, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda out: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect() if r.doc_id in (None, 7000, 8000) and r.text != "no id"))
    want = lambda gone: sorted((i is None, i or 0, t) for i, t in odd if t not in gone)
    assert own(corpus_pipeline.drop_toxic(spark, frame, str(tmp_path))) == want({toxic})
    assert own(corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path))) == want({leaked})
    first = [(False, 7000, clean[2]), (False, 7000, clean[3]), (False, 8000, clean[4]), (True, 0, clean[0]), (True, 0, clean[1])]
    assert own(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([r for r in rows if r[1] not in (toxic, leaked)], SCHEMA), "")) == sorted(first)


def test_stages_keep_columns_of_any_name_and_kind(spark, tmp_path):
    docs, labels, bench = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = SCHEMA + ", _key0 string, _Row0 int, `a.b` string, m map<string,int>, n_lines string, n_dropped double, block int, found string, tick int, key long, row long, h string"
    frame = spark.createDataFrame([(*r, f"k{i % 3}", i, f"dot{i}", {"x": i, "y": 1}, f"lines{i}", 0.5, i, "f", i, i, -i, "h") for i, r in enumerate(docs[:120] + docs[-8:] + docs[5:6])], schema)
    own = lambda df: {(r["doc_id"], r["_Row0"]): (r["_key0"], r["a.b"], r["m"], r["n_lines"], r["n_dropped"], r["tick"], r["row"]) for r in df.collect()}
    rows, before = frame, own(frame)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.columns == frame.columns, name
        after = own(rows)
        assert after and len(after) < len(before) and all(before[k] == v for k, v in after.items()), name
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() >= len(before)
