import random

import numpy as np
import pyarrow as pa

from pagelens.llm import decontaminate, langid, linededup, topk, toxicity

LANGS = {"en": "the of and that with this from were have which".split(), "de": "der die und nicht über schön werden größe".split(), "ru": "это был который всегда может слово".split()}
DOCS = "doc_id long, text string, lang string, score double, h int, n_lines string"


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        yield i, " ".join(rng.choices(LANGS[lang], k=rng.randint(3, 40))), lang


def test_language_id(spark):
    rows = [(i, t, g) for i, t, g in texts(1, 240)]
    mixed = " ".join(LANGS["en"] * 3 + LANGS["ru"] * 3 + ["12", "--"] + LANGS["de"] * 3)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, " 12 -- !! \u0301", None), (1003, mixed, None), (1004, "漢字", None), (1005, "der die " * 30_000, None), (None, "the of and", "en"), (1003, mixed, None)]
    frame = spark.createDataFrame([(i, t, g, 0.5, 1, "x") for i, t, g in rows + odd], DOCS)
    got = langid.learn_and_identify(frame).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == g and by_id[i].score > 0.9 for i, _, g in rows)
    assert any(by_id[i].held_out for i, _, _ in rows) and not by_id[None].held_out
    assert [(by_id[i].lang_pred, by_id[i].score, by_id[i].spans) for i in (1000, 1001, 1002)] == [("und", 0.0, [])] * 3
    assert by_id[1004].lang_pred in LANGS and by_id[1005].lang_pred == "de"
    spans = by_id[1003].spans
    assert [s.lang for s in spans] == ["en", "ru", "de"] and spans[0].from_word == 0 and spans[0].to_word == 30 == spans[1].from_word and spans[-1].to_word == 74
    assert [r.lang_pred for r in langid.identify(frame.limit(2), langid.learn(frame.limit(0))).collect()] == ["und"] * 2
    assert langid.learn_and_identify(frame.limit(0)).count() == 0


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 0, 6]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.normal(size=(offsets[-1], 3)) * 3
    got = langid.viterbi(scores, offsets, 2.0)
    for i, n in enumerate(lengths):
        part = scores[offsets[i] : offsets[i] + n]
        worth = lambda p: sum(part[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        paths = [tuple(int(x) for x in np.base_repr(c, 3).zfill(n)[-n:]) for c in range(3**n)] if n else []
        if paths:
            assert abs(worth(tuple(got[offsets[i] : offsets[i] + n])) - max(map(worth, paths))) < 1e-9


def test_toxicity(spark):
    rng = random.Random(4)
    clean = [w for g in LANGS.values() for w in g] + [f"{a}{b}{c}" for a in ("ta", "re", "mo", "il") for b in ("s", "n", "r") for c in ("on", "ing", "ed")]
    bad = ["vermin", "dunce", "filthy"]
    hidden = {"vermin": ["verm1n", "v.e.r.m.i.n", "verrrrmin", "v e r m i n", "VERM!N"], "dunce": ["dunc3", "d_u_n_c_e", "duuuunce"], "filthy": ["f1lthy", "filthyyyy", "fi1thy"]}
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=30)
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                word = rng.choice(bad)
                words.insert(rng.randrange(30), rng.choice(hidden[word]) if i % 2 else word)
        docs.append((i, " ".join(words), "en", 0.5, 1, "x"))
        labels.append((i, 1 if i % 2 else 0, int(toxic)))
    docs += [(5000, None, None, None, None, None), (5001, "", "en", 1.0, 1, ""), (None, "vermin", "en", 1.0, 1, ""), (5002, "the of " * 40_000 + "dunce", "en", 1.0, 1, ""), (5003, "$ 1 2 3 4 5 6 @ é a", "en", 1.0, 1, "")]
    labels += [(None, 1, 1), (5001, 1, None), (0, 1, 0)]
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, marks)
    got = toxicity.learn_and_score(frame, marks).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    wrong = [i for i in range(900) if by_id[i].held_out and by_id[i].predicted != (i % 3 == 0)]
    assert len(wrong) <= 4
    letters = toxicity.LetterModel(model.trigrams)
    for word, forms in hidden.items():
        for form in forms:
            assert toxicity.restore(f"the {form} with", letters) == f"the {word} with", form
    empty = toxicity.learn_and_score(frame, marks.limit(0)).collect()
    assert len({r.score for r in empty}) == 1 and empty[0].score < 0.5
    assert toxicity.learn_and_score(frame.limit(0), marks).count() == 0


def test_max_score_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=24).astype("f4").tolist()) for i in range(900)]
    rows += [(2000 + i, [1.0] * 24) for i in range(40)] + [(3000, [0.5] * 24), (3100, None), (3200, []), (3300, [float("nan")] * 24), (3400, [None] * 24), (3500, [float("inf")] * 24), (3600, [0.25] * 8), (3601, [1e9] * 8), (3700, [1e15] * 8), (3701, [-1e30, 1e30] * 4), (3800, [3e38] * 8), (100, rows[100][1])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    vectors = topk.integer_vectors(frame)
    sound = [(i, np.array([int(x) for x in np.floor(np.array(v, "f4").astype("f8") * 1024)], object)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {i: v for i, v in sound if i % 100 == 0}.items():
        scores = sorted((-min(max(int(a @ b), -(2**63)), 2**63 - 1), i) for i, b in sound if i != q and len(b) == len(a))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    for block, seeds in ((100, 50), (100_000, 0), (100_000, 2000)):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), block=block, seeds=seeds).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(4000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(14, 50)))) for k in range(40)] + [(90, None), (91, ""), (92, "short item"), (None, "nine small tokens make a short item of nine"), (93, " ".join(rng.choices(vocab, k=30)))]
    items.append((94, items[-1][1]))
    docs, want = [], {}
    for i in range(300):
        words, planted = rng.choices(vocab, k=rng.randint(5, 300)), set()
        if i % 3 == 0:
            k = rng.randrange(40)
            own = items[k][1].split()
            if i % 2:  # every seventh token is another one
                own = [w if j % 7 != 3 else "other" for j, w in enumerate(own)]
            at = rng.randrange(len(words))
            words[at:at] = ["(" + own[0].upper(), *own[1:]]
            planted = {k}
        docs.append((i, " ".join(words)))
        want[i] = planted
    docs += [(500, None), (501, ""), (502, items[3][1]), (None, items[4][1]), (503, items[44][1]), (504, "nine small tokens make a short item of nine"), (505, "a b c " * 20_000 + items[5][1])]
    want |= {500: set(), 501: set(), 502: {3}, None: {4}, 503: {93, 94}, 504: {None}, 505: {5}}
    frame = spark.createDataFrame([(i, t, "en", 0.1, 1, "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert len(got) == len(docs) and all(set(r.item_ids) == want[r.doc_id] and r.contaminated == bool(want[r.doc_id]) for r in got)
    parts = decontaminate.overlaps(frame, bench, block_tokens=300).collect()
    assert len(parts) == len(docs) and all({x.item_id for x in r.found} == want[r.doc_id] for r in parts)
    for block_tokens in (2_000_000, 600):
        clean = decontaminate.clean_documents(frame, bench, block_tokens)
        assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, w in want.items() if not w)
    twice = frame.union(frame).where("doc_id in (0, 1)")
    assert sorted(r.doc_id for r in decontaminate.contaminated(twice, bench).where("contaminated").collect()) == [0, 0] and [r.doc_id for r in decontaminate.clean_documents(twice, bench).collect()] == [1, 1]
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).where("contaminated").count() == 0


def plain_overlap(a, b):
    """Whether some run of aligned tokens is an overlap: every diagonal, every run."""
    need = min(13, len(b))
    if len(b) < 4:
        return False
    if len(b) < 8:
        return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
    for d in range(-len(b) + need, len(a) - need + 1):
        at = max(0, d)
        equal = [x == y for x, y in zip(a[at:], b[at - d :], strict=False)]
        same = [i for i, e in enumerate(equal) if e]  # a run begins and ends with an equal token
        if any(y - x >= need - 1 and 5 * (j - i + 1) >= 4 * (y - x + 1) for i, x in enumerate(same) for j, y in enumerate(same[i:], i)):
            return True
    return False


def test_overlaps_match_every_diagonal_and_run():
    rng = random.Random(12)
    vocab = "abcdefghijklmnopqrstuv"
    items = [[rng.choice(vocab) for _ in range(rng.choice((3, 5, 7, 8, 9, 11, 13, 16, 30)))] for _ in range(60)]
    index = decontaminate.Index.of([(k, " ".join(w)) for k, w in enumerate(items)])
    hits = 0
    for _ in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        own = list(rng.choice(items))
        for at in rng.sample(range(len(own)), len(own) * rng.choice((0, 1, 2, 3)) // 10):
            own[at] = rng.choice(vocab)
        at = rng.randrange(len(words) + 1)
        words[at:at] = own
        found, offsets = decontaminate.tokens(pa.array([" ".join(words)]))
        got = {k for _, k, d in index.diagonals(found, offsets).tolist() if index.overlap(found, k, d)[1]}
        want = {k for k, item in enumerate(items) if plain_overlap(words, item)}
        assert got == want
        hits += len(want)
    assert hits > 100


def test_masks_lose_no_overlap():
    from itertools import combinations

    for n in range(8, 26):
        windows = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for at in range(n - len(m) + 1)]
        for gone in combinations(range(n), int(0.2 * n + 1e-9)):
            wrong = sum(1 << i for i in gone)
            assert any(not w & wrong for w in windows), (n, gone)


def plain_line_dedup(rows, min_docs=3, long=30):
    """A direct version: each line's own form and every template that keeps three or four of five stretches."""
    from collections import defaultdict
    from itertools import combinations

    def mask(line):
        words = [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
        wild = ["<*>" if any(c in "0123456789" for c in w) else w for w in words]
        return tuple(words if 2 * wild.count("<*>") > len(words) else wild)

    def templates(m):
        yield m
        if len(m) >= 7:
            ends = [3 + -(-j * (len(m) - 3) // 5) for j in range(6)]
            for gone in [*combinations(range(5), 1), *combinations(range(5), 2)]:
                form = list(m)
                for j in gone:
                    form[ends[j] : ends[j + 1]] = [None] * (ends[j + 1] - ends[j])
                if form.count(None) <= 0.4 * (len(m) - 3) + 1e-9:
                    yield (gone, *form)

    docs = [(i, t) for i, t in rows if i is not None and t is not None]
    of = defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            if m := mask(line):
                for form in templates(m):
                    of[form, len(m)].add(i)
    first = {form: min(ids) for (form, n), ids in of.items() if len(ids) >= min_docs or (len(ids) >= 2 and n >= long)}
    stays = lambda m, i: not m or all(i <= first.get(form, i) for form in templates(m))
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
        else:
            out.append((i, "\n".join(x for x in t.split("\n") if stays(mask(x), i))))
    return out


def test_line_templates_do_not_depend_on_what_else_is_in_the_leaf(spark):
    vocab = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    for n in (6, 60):
        rows = []
        for i in range(n):
            # One field with a dominant value, and two templates of one leaf.
            status = "fine" if i % 3 else f"odd{vocab[i]}"
            rows.append((3 * i, f"the node reports {status} after the nightly run of all jobs"))
            rows.append((3 * i + 1, f"the node reports that {vocab[i]} left the group for another one"))
            rows.append((3 * i + 2, " ".join(vocab[(7 * i + 11 * k) % 400] for k in range(11))))
        frame = spark.createDataFrame([(i, t, "en", 0.1, 1, "x") for i, t in rows], DOCS)
        kept = {r.doc_id for r in linededup.dedup_lines(frame).collect() if r.text}
        assert kept == {0, 1, *(3 * i + 2 for i in range(n))}


def test_line_dedup_of_a_long_text_and_clashing_names(spark):
    rows = [(i, "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} here" for k in range(9000))) for i in range(3)]
    frame = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, lines int, `drop` string, `g.0` int")
    got = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    assert got[0].text == rows[0][1] and [got[i].text for i in (1, 2)] == ["", ""] and got[2].n_dropped == got[2].n_lines == 9000 and got[1]["g.0"] == 2 and got[1]["drop"] == "a"


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(3)
    vocab = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    common = [" ".join(rng.choices(vocab, k=n)) for n in (1, 4, 9, 33)]
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(common))
        if i % 5 == 0:
            lines.append(f"User {i} logged in from host {rng.choice(vocab)} at port {i * 7}")
        if i % 7 == 0:
            lines += ["", "  ", f"{i} {i}", "12 34 x"]
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (None, rows[0][1]), (302, rows[5][1]), (5, rows[5][1]), (5, "another\n" + common[1]), (303, "\n".join(common) + "\ttail\r\n" + " ".join(vocab * 50))]
    frame = spark.createDataFrame([(i, t, "en", 0.1, 1, "x") for i, t in rows], DOCS)
    got = linededup.dedup_lines(frame).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)) == sorted((i is None, i or 0, t or "") for i, t in plain_line_dedup(rows))
    assert sum(r.n_dropped for r in got) > 60 and linededup.dedup_lines(frame).columns == [*(c for c in frame.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert linededup.dedup_lines(frame.limit(0)).count() == 0


def test_string_bytes_of_slices():
    from pagelens.llm.common import string_bytes

    data, offsets = string_bytes(pa.array(["ab", "", "é", "x"]).slice(1, 2))
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2]
