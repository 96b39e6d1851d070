import random

import corpus_pipeline
from pagelens.llm import neardup

SCHEMA = "doc_id long, text string, lang string"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_survivors(rows):
    """All pairs by Jaccard similarity, and the smallest (id, nulls last) of each group."""
    sets = [plain_set(t) for _, t in rows]
    leader = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]) > 0:
                a, b = leader[x], leader[y]
                leader = [b if g == a else g for g in leader]
    best = {}
    for g, (i, _) in zip(leader, rows, strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return sorted(best.values())


def near_copies():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [(0, None), (1, ""), (2, "few words"), (3, "Few  words")], 4
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randint(60, 200))
        for edits in (0, 1, 2, 3, 4, 5):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"new{n}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def test_near_copies_match_brute_force_jaccard(spark):
    rows = near_copies()
    want = plain_survivors(rows)
    assert 80 < len(want) < len(rows) - 100
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert got.columns == frame.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    # The same with gathered texts dealt over pairs of blocks.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.drop_copies(frame, block_bytes=900).collect()) == want
