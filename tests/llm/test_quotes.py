import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd

from pagelens.llm import oracles, quotes

SCHEMA = "conv_id long, turn long, role string, text string, mid int, level string"


def conversations(seed=3):
    """Mail-like threads: replies quote whole texts, single lines, re-wrapped passages and quotes of quotes."""
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)]
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(rng.randint(1, 12)):
            own = ["\n".join(" ".join(rng.choices(vocab, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2))]
            lines = []
            for old in rng.sample(texts, min(len(texts), rng.choice((0, 1, 1, 2)))):
                quoted = old.split("\n")
                if rng.random() < 0.3:  # one line only
                    quoted = [rng.choice(quoted)]
                elif rng.random() < 0.3:  # wrapped anew, other case
                    quoted = [" ".join(quoted).upper()] if ">" not in old and "\n\n" not in old else quoted
                lines += [*rng.choice(([], ["On Monday X wrote:"])), *(rng.choice(("> ", ">")) + x for x in quoted), *rng.choice(([""], []))]
            texts.append("\n".join([*lines, "\n\n".join(own)]))
            rows.append((conv, turn, rng.choice(("user", "assistant")), texts[-1]))
    rows += [(900, 0, "user", "same words here"), (900, 0, "assistant", "same words here"), (900, 1, "user", "> same words here\nyes"), (900, 2, "user", "> same words here\n> yes\nno"), (900, 3, "a", "> not said by anyone\n> > yes"), (900, 1, "user", "> same words here\nyes")]
    rows += [(901, 0, "u", "one two"), (901, 1, "u", "three four"), (901, 2, "u", "> one two\n> three four\nanswer"), (901, 3, "u", "> answer of later\nx"), (901, 4, "u", "answer of later")]
    rows += [(None, 0, "u", "text"), (None, 1, "u", "> text"), (902, None, "u", "alpha"), (902, 1, None, "> alpha"), (903, 0, "u", None), (903, 1, "u", ""), (904, 0, "u", "deep"), (904, 1, "u", "> " * 300 + "deep"), (904, 2, "u", "> deep\n" * 3000)]
    return rows


def plain(rows):
    """(conv_id, turn, role, text): (thread_turn, depth, parent_turn, n_quoted, n_linked), message by message."""
    messages = sorted({(c, t, r, x or "") for c, t, r, x in rows}, key=str)
    mark = re.compile(r"^(?:[ \t]*>)+")
    units, quoted = {}, {}
    for m in messages:
        runs, before = [], None
        for at, line in enumerate(m[3].split("\n")):
            head = mark.match(line)
            level, body = (head[0].count(">"), line[head.end() :]) if head else (0, line)
            body = re.sub(r"[ \t\n\x0b\f\r]+", " ", body.lower()).strip(" ")
            if before is None or before[0] != level or before[1] == "":
                runs.append((level, []))
            before = level, body
            if body:
                runs[-1][1].append((at, body))
        runs = [r for r in runs if r[1]]
        quoted[m] = sum(level > 0 for level, _ in runs)
        units[m] = [(level, lines[0][0], text) for level, lines in runs for text in [" ".join(b for _, b in lines), *([b for _, b in lines] if len(lines) > 1 else [])]]
    first = {}
    for m in messages:
        if m[0] is not None and m[1] is not None:
            for level, _, text in units[m]:
                if level == 0 and (m[0], text) not in first or level == 0 and first[m[0], text][1] > m[1]:
                    first[m[0], text] = m
    parent, linked = {}, {}
    for m in messages:
        votes, passages = defaultdict(int), set()
        for level, at, text in units[m]:
            source = first.get((m[0], text)) if level and m[1] is not None else None
            if source and source[1] < m[1]:
                votes[level, source] += len(text.split(" "))
                passages.add(at)
        linked[m] = len(passages)
        if votes:
            parent[m] = min(votes, key=lambda k: (k[0], -votes[k], -k[1][1]))[1]
    out = []
    for m in messages:
        root, depth = m, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out.append((m[0], m[1], m[2], root[1], depth, parent[m][1] if m in parent else None, quoted[m], linked[m]))
    return sorted(out, key=str)


def test_quotations_match_plain_version_and_sql(spark):
    rows = conversations()
    got = quotes.link_quotations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).toPandas()
    names = ["conv_id", "turn", "role", "thread_turn", "depth", "parent_turn", "n_quoted", "n_linked"]
    clean = lambda frame, columns: sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame[columns].itertuples(index=False)), key=str)
    as_int = lambda rows: [tuple(int(v) if isinstance(v, (float, np.integer)) else v for v in r) for r in rows]
    want = plain(rows)
    assert sorted(as_int(clean(got, names)), key=str) == want
    assert sum(r[5] is not None for r in want) > 80 and max(r[4] for r in want) > 3 and sum(r[7] for r in want) > 100
    assert not (got["n_linked"] > got["n_quoted"]).any() and not got["text"].str.contains(r"(?m)^[ \t]*>").any()
    conversations_ = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db = duckdb.connect()
    db.register("conversations", conversations_)
    sql = db.sql(oracles.QUOTATIONS).df()
    every = [*names, "text", "chat"]
    assert sorted(as_int(clean(sql, every)), key=str) == sorted(as_int(clean(got, every)), key=str)


def test_native(spark):
    """The main path starts no Python worker."""
    plan = quotes.link_quotations(spark.createDataFrame([(1, 0, "u", "a", 1, "x"), (1, 1, "u", "> a", 1, "x")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups", plan)
