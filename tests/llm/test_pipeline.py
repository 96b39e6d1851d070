import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pagelens.llm import toxicity
from tests.llm.test_neardup import plain_survivors
from tests.llm.test_text_operators import plain_line_dedup


def fixture():
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "il", "sa", "vu") for b in "snrlkt" for c in ("on", "ing", "ed", "or")]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    bench = [(k, text(30)) for k in range(6)]
    docs, labels, common = [], [], text(40)
    for i in range(240):
        lines = [text(rng.randint(20, 60)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            words = lines[0].split()
            words.insert(5, "vermin")
            lines[0] = " ".join(words)
        if i % 9 == 1:
            lines.append(common)
        if i % 20 == 3:
            lines[0] += " " + bench[i // 20 % 6][1]
        docs.append([i, "\n".join(lines)])
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [[1000 + k, docs[5][1]] for k in range(4)] + [[1100, docs[7][1] + " more"], [1101, docs[7][1].replace(" ", "  ")], [1200, None], [1201, ""], [None, "no id"]]
    return [(i, t, "en", "src", len(t or ""), "extra") for i, t in docs], labels, bench


def test_pipeline_matches_plain_version(spark, tmp_path):
    docs, labels, bench = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")

    toxic = {r.doc_id for r in toxicity.learn_and_score(frame, marks).where("predicted = 1").collect()}
    assert toxic == {i for i in range(0, 240, 4)}
    rows = [(i, t) for i, t, *_ in docs if i not in toxic]
    cut = plain_line_dedup(rows)
    rows = [(i, new) for (i, old), (_, new) in zip(rows, cut, strict=True) if new == old or new.strip()]
    stays = {(i, none) for none, i in plain_survivors(rows)}
    rows = [(i, t) for i, t in rows if (i or 0, i is None) in stays]
    rows = [(i, t) for i, t in rows if not any(item in (t or "") for _, item in bench)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}

    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(got) == want and 40 < len(want) < 200


def test_stages_on_empty_documents(spark, tmp_path):
    docs, labels, bench = fixture()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels[:0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench[:0], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
