import random
import re
import zlib
from collections import Counter, defaultdict

from pagelens.llm import spelling


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    """By comparing all pairs."""

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if a != b and one(a, b):
                near[a].append(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n, form[w], counts[form[w]] if form[w] else None, len(near[w]), root))
    return rows


def collected(df):
    return [(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()]


def fixture():
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcéÿ", k=rng.randint(4, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 300, "y" + "x" * 300, "x" * 150 + "y" + "x" * 150]
    docs = []
    for i in range(400):
        words = rng.choices(stems, k=rng.randint(0, 60))
        for at in rng.sample(range(len(words)), len(words) // 3):
            w, k = words[at], rng.randrange(len(words[at]))
            words[at] = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :], w.upper()])
        docs.append((i, rng.choice([" ", ", ", "-1-", "\n"]).join(words)))
    return docs + [(None, "hello " * 50), (None, "hello " * 50), (7, None), (8, ""), (9, "hallo hallo hallo hullo hullo hullo ×÷×÷× ×÷×÷× ×÷×÷×")] + docs[:3]


def test_variants_match_all_pairs(spark):
    docs = fixture()
    counts = plain_words(docs)
    want = plain_variants(counts)
    assert len(want) >= 300 and max(r[4] for r in want) > 5
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    for block in (spelling.BLOCK, 4, 2):  # blocks are subdivided down to a single code point
        got = collected(spelling.variants(frame, block))
        assert len(got) == len(want) and set(got) == want


def test_crowded_block_of_equal_ends(spark):
    """All words share both ends; the block ends as one code point that differs, and no pair is found twice."""
    rng = random.Random(2)
    counts = {f"abcd{a}{b}wxyz": rng.randint(3, 40) for a in "abcdefgh" for b in "abcdefgh"} | {f"abcd{a}wxyz": rng.randint(3, 40) for a in "abcdefgh"}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.top_n, r.top) for r in spelling.near(frame, 3).collect()}
    want = {}
    for w, _, _, _, k, _ in plain_variants(counts):
        others = [x for x in counts if x != w and x in {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abcdefghwxyz"} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abcdefghwxyz"}]
        best = min(others, key=lambda x: (-counts[x], x))
        want[w] = (k, counts[best], best)
    assert got == want


def test_chain_of_forms(spark):
    counts = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96, "zzzzzz": 5}
    forms = spark.createDataFrame([("aaaaaa", "aaaaab"), ("aaaaab", "aaaabb"), ("aaaabb", "aaabbb"), ("aaabbb", "aabbbb"), ("aabbbb", "abbbbb")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {w: "abbbbb" for w in list(counts)[:5]}
    docs = spark.createDataFrame([(10_000 + i, w) for w, n in counts.items() for i in range(n)], "doc_id long, text string")
    assert {r.word: r.root for r in spelling.variants(docs).collect()} == {r[0]: r[5] for r in plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))}


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0
