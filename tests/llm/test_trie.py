import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from pagelens.llm import trie
from pagelens.llm.common import joined_by_key

SCHEMA = "conv_id long, turn long, role string, text string, node string, n long"


def plain_trie(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5("\0".join((str(len(role)), role, text)).encode()).hexdigest()
            turns[conv_id].append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}

    def sums(node):
        got = [below[x] for x in children[node]]
        below[node] = (sum(x[0] for x in got) if got else 1, sum(x[1] for x in got) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0))

    for node in sorted(members, key=len, reverse=True):
        sums(node)
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(paths[c]) == len(node))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(9)
    lines = ["", "hello", "what is it", "no", "naïve — ünïcode", "x" * 3000]
    rows = []
    for c in [*range(0, 260), *range(-120, -90), 10**12, 10**12 + 1, 777, 778]:
        for turn in range(rng.choice([0, 1, 2, 3, 8, 20])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(lines[:2] if turn < 3 else [*lines, None])))
    rows += [(300, t, "user", "the same") for t in range(40)] + [(301, 1, "user", "twice")] * 5 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    for c in range(400, 500):  # a hundred equal conversations
        rows += [(c, t, "user", f"turn {t}") for t in range(7)]
    rng.shuffle(rows)
    return rows


def collected(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("apart", [False, True])
def test_trie_matches_plain_version(spark, monkeypatch, apart):
    rows = fixture()
    want = plain_trie(rows)
    assert len(want) > 400 and max(w[1] for w in want) >= 40
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    if apart:  # conversations over partitions and stretches, frequent keys apart, ids joined in pieces
        monkeypatch.setattr(trie, "JOINED", 20)
        monkeypatch.setattr(trie, "joined_by_key", lambda a, b, key: joined_by_key(a, b, key, hot=10, small=1))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collected(trie.prefix_trie(frame, 3 if apart else trie.STRETCH)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", None, None)], SCHEMA)).count() == 0


def test_turnless_conversation_ends_at_the_root(spark):
    lost = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 == 5)
    frame = spark.createDataFrame([(lost, 1, "user", "gone", None, None)], SCHEMA)
    assert collected(trie.prefix_trie(frame)) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
