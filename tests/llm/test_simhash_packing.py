import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from pagelens.llm import packing, simhash

SCHEMA = "doc_id long, text string, lang string, fp long, leaf int, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def samples():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß x", "A"]
    texts = [None, "", " \t\n", "One", "two Words", "a b c", "a b c d", "A  B\tC\nd", "word " * 3000]
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randint(150, 400))
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = "edited"
    texts += texts[:15]
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (1, None)]


def test_fingerprints_and_groups_match_brute_force(spark):
    rows = samples()
    got = simhash.near_duplicate_groups(frame(spark, rows)).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((i or 0, f) for i, f in fps)
    group = {f: {f} for _, f in fps}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    ids = defaultdict(list)
    for i, f in fps:
        if i is not None:
            ids[id(group[f])].append(i)
    want = {f: min(ids[id(g)], default=None) for f, g in group.items()}
    assert all(r.component_id == want[r.fp % 2**64] for r in got)
    assert len({r.component_id for r in got}) < len(group)


def test_shards_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    noisy = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fps = np.unique(np.concatenate((base, noisy, dense)))
    place = {f: i for i, f in enumerate(fps.tolist())}
    forests = []
    for shard in (200, 4):  # one part of the bits is enough, or two are needed
        tree = simhash.Tree(fps[::3], len(fps), 4, shard)
        owned, copies, pieces = np.zeros(len(fps), int), np.zeros(len(fps), int), defaultdict(list)
        for _, at, own in tree.route(fps):
            owned[at[own]] += 1
        assert (owned == 1).all()
        for leaf, piece, at, own in tree.deal(fps, shard):
            copies[at] += 1
            for k in np.unique(piece).tolist():
                pieces[leaf, k].append((at[piece == k], own[piece == k]))
        assert copies.max() <= 4 * 25 and len(pieces) > 20
        forest = simhash.Forest(len(fps))
        for rows in pieces.values():
            at, own = np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])
            a, b = simhash.link_shard(fps[at], own, 4)
            assert len(a) < len(at)
            forest.join(np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
        forests.append(forest)
    exact = simhash.Forest(len(fps))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    exact.join(x, y)
    assert all((exact.root == forest.root).all() for forest in forests)


def test_crowds_and_copies_a_fingerprint():
    rng = np.random.default_rng(8)
    flips = lambda n, k: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    crowd = np.unique(np.concatenate((np.uint64(7) ^ flips(4000, 3), np.uint64(7) ^ flips(3000, 6), np.uint64(7) ^ flips(500, 9), rng.integers(0, 2**63, 500, dtype=np.uint64))))
    own = rng.random(len(crowd)) < 0.8
    a, b = simhash.link_shard(crowd, own, 4)
    assert len(a) < len(crowd) and (own.any() and not own.all())
    place = {f: i for i, f in enumerate(crowd.tolist())}
    got, exact = simhash.Forest(len(crowd)), simhash.Forest(len(crowd))
    got.join(np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
    x, y = np.nonzero(np.bitwise_count(crowd[:, None] ^ crowd[None, :]) <= 4)
    exact.join(x, y)
    needed = own[x] | own[y]
    at_least = simhash.Forest(len(crowd))
    at_least.join(x[needed], y[needed])
    # All links with an own end are found, and nothing is joined that true links do not join.
    assert len(np.unique(np.stack((at_least.root, got.root)), axis=1).T) == len(np.unique(at_least.root)) and len(np.unique(np.stack((got.root, exact.root)), axis=1).T) == len(np.unique(got.root))
    # The number of copies does not grow with the table.
    many = rng.integers(0, 2**63, 400_000, dtype=np.uint64)
    share = []
    for n in (50_000, 400_000):
        tree = simhash.Tree(many[:16_384], n, 4, 1000)
        share.append(sum(len(at) for _, _, at, _ in tree.deal(many[:n], 1000)) / n)
    assert share[1] <= 1.1 * share[0] <= 1.1 * 5 * 2.1


def test_empty_tables(spark):
    assert simhash.near_duplicate_groups(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_round_trip(spark):
    rows = samples() + [(9000 + i, "Ñandú <|endoftext|> " * i) for i in range(60)] + [(9500, "a<|endoftext|><|endoftext|>b <|endoftext |>"), (9501, "<|endoftext|>"), (9502, "word" * 40_000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(frame(spark, rows), buffer=30_000, step=8192).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, docs in want.items():
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                ids = np.array(docs[0][r.start : r.start + r.length], "<u4")
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(docs[0]), zlib.crc32(ids.tobytes()))
                at += r.length
            assert at == len(docs[0])
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, docs))
    for rows_ in windows.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    steps = defaultdict(int)
    for r in got:
        steps[r.step_id] += r.length
    assert max(steps.values()) - min(steps.values()) <= 8192
