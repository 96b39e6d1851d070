import random

import pyarrow as pa

from pagelens.llm import decontaminate


def plain_overlap(equal, need):
    """Whether any run between equal tokens is long and equal enough."""
    at = [i for i, e in enumerate(equal) if e]
    return any(j - i + 1 >= need and 5 * sum(equal[i : j + 1]) >= 4 * (j - i + 1) for i in at for j in at if j >= i)


def test_any_run_of_a_diagonal_counts(spark):
    rng = random.Random(6)
    index = decontaminate.Index.of([(1, " ".join(f"w{i}" for i in range(60)))])
    for share in (0.5, 0.7, 0.8, 0.85, 0.9) * 60:
        n = rng.choice((13, 20, 40, 60))
        equal = [rng.random() < share for _ in range(n)]
        found, _ = decontaminate.tokens(pa.array([" ".join(f"w{i}" if e else f"x{i}" for i, e in enumerate(equal))]))
        start, size, same = index.overlap(found, 0, 0)
        assert bool(size) == plain_overlap(equal, 13), equal
        assert not size or (size >= 13 and same == sum(equal[start : start + size]) and 5 * same >= 4 * size)

    item = [f"item{i}" for i in range(51)]
    gaps = [w if i % 19 < 13 else f"edit{i}" for i, w in enumerate(item)]  # 13 equal, 6 changed, 13, 6, 13
    short = [w if i % 19 < 9 else f"edit{i}" for i, w in enumerate(item)]  # never 13 tokens that are 80 % equal
    frame = spark.createDataFrame([(1, "before " * 5 + " ".join(gaps) + " after"), (2, " ".join(short))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(frame, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()}
    assert got[1].item_ids == [9] and got[1].longest >= 13 and not got[2].contaminated


def test_common_passage_costs_its_overlaps_once():
    """500 items and 1,000 texts share a passage: half a million overlaps, each looked at once, a bounded number at a time."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(20_000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    common = text(20)
    index = decontaminate.Index.of([(k, f"{text(20)} {common} {text(20)}") for k in range(500)])
    found, offsets = decontaminate.tokens(pa.array([f"{text(20)} {common} {text(20)}" for _ in range(1000)]))
    rows = index.diagonals(found, offsets)
    runs = index.runs(found, offsets, rows)
    assert (runs[:, 1] >= 20).sum() == 500_000 and len(rows) < 501_000
    at = rng.sample(range(len(rows)), 300)
    for (t, k, d), run in zip(rows[at].tolist(), runs[at].tolist(), strict=True):
        assert list(index.overlap(found[offsets[t] : offsets[t + 1]], k, d)) == run


def test_runs_as_arrays_are_those_of_each_diagonal():
    rng = random.Random(5)
    vocab = "abcdefghijklmnopqrstuv"
    many = 0
    for _ in range(30):
        items = [[rng.choice(vocab) for _ in range(rng.choice((3, 5, 7, 8, 9, 11, 13, 16, 30, 60)))] for _ in range(60)]
        index = decontaminate.Index.of([(k, " ".join(w)) for k, w in enumerate(items)])
        texts = []
        for _ in range(20):
            words, own = [rng.choice(vocab) for _ in range(rng.randint(0, 60))], list(rng.choice(items))
            for at in rng.sample(range(len(own)), len(own) * rng.choice((0, 1, 2, 3)) // 10):
                own[at] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
            texts.append(" ".join(words))
        found, offsets = decontaminate.tokens(pa.array(texts))
        rows = index.diagonals(found, offsets)
        for (t, k, d), run in zip(rows.tolist(), index.runs(found, offsets, rows).tolist(), strict=True):
            want = index.overlap(found[offsets[t] : offsets[t + 1]], k, d)
            assert list(want) == run if want[1] else run[1] == 0
            many += want[1] > 0
    assert many > 200
