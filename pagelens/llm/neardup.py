"""Near copies by word shingles: SimHash trees and MinHash bands propose links, exact shingle similarity decides.

A text's shingles are those of the SimHash fingerprint with `SHINGLE` words (A-Z lower-cased, ASCII white space; fewer
words: the whole sequence), as a set.  Two texts are near copies if the Jaccard similarity of their sets is `SIMILAR` or
more, and a group is what near copies connect; texts without words are one group.

At similarity 0.8 fingerprints differ by about 10 bits of 64, and by 17 for one pair in a hundred.  The vantage-point
trees cannot carry that radius (at a median distance near 32 almost all fingerprints cross each boundary), so they propose
what is within `RADIUS` bits, and `BANDS` bands of `ROWS` MinHash values the rest: a pair of similarity 0.8 shares no band
with a probability of (1 - 0.8 ** 4) ** 24, 3 in a million.  Proposed links only gather the texts that may belong
together (a star for each band); within those, all pairs that could reach the similarity are compared in full, by a
prefix filter that loses none.

Gathered texts beyond `BLOCK_BYTES` are dealt over blocks, each of which is compared by itself.  What the blocks found is
put together by one text for each large group of a block, which joins the parts of a large group of copies.  Only the texts
outside a label's largest group then still go to all of its blocks, so a large group is never sent more than twice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import simhash
from pagelens.llm.common import broadcast_if_small, checkpointed, trim
from pagelens.llm.components import connected_components

SHINGLE, RADIUS = 5, 4
#: Similarity of near copies as a fraction of integers.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 4
BLOCK_BYTES = 6 << 20

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(joined)]))
    starts, ends = (starts[:1], ends[-1:]) if len(starts) < shingle else (starts[: len(starts) - shingle + 1], ends[shingle - 1 :])
    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    cut = map(slice, starts.tolist(), ends.tolist())
    return np.unique(np.fromiter(map(digest, map(joined.__getitem__, cut)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """The signed hash of each band of MinHash values; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 2048):
        np.minimum(low, ((hashes[None, i : i + 2048] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(1), out=low)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(low.reshape(BANDS, ROWS))]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row, node, bands): the hashes of each row's text, of all its columns and of its set, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(x.as_py() or b"") for x in batch.column("text").cast(pa.large_binary()))
            found = [(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), bands(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "key", "row")), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int64()))], ["doc_id", "key", "row", "node", "bands"]
            )
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, row long, node long, bands array<long>")


def text_key():
    return F.xxhash64("text")


def row_key(docs: DataFrame):
    """The hash of all columns of a row, whatever they are named; maps and variants count by their JSON."""
    own = lambda f: F.to_json(F.struct(_named(f.name))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else _named(f.name)
    return F.xxhash64(*map(own, docs.schema.fields))


def _named(column: str):
    """A column by its whole name, which may hold dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def near(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between positions that connect all sets of enough similarity with one another.

    First each set is compared with the first sets of the groups found so far; then only with members of groups that it
    is not connected with, so a large group costs its size and not its square.
    """
    part, whole = SIMILAR
    root, found = list(range(len(sets))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def joins(x: int, y: int) -> bool:
        """Compares two sets, of which y is not the larger one."""
        if whole * len(sets[y]) < part * len(sets[x]):
            return False
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if whole * both < part * (len(sets[x]) + len(sets[y]) - both):
            return False
        root[top(x)] = top(y)
        found.append((x, y))
        return True

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    start = {x: sets[x][: len(sets[x]) + (-part * len(sets[x])) // whole + 1].tolist() if len(sets[x]) else [] for x in order}
    leaders: dict[int, list[int]] = {}
    leader = list(range(len(sets)))
    for x in order:
        for y in dict.fromkeys(y for h in start[x] for y in leaders.get(h, ())):
            if joins(x, y):
                leader[x] = y
                break
        else:
            for h in start[x]:
                leaders.setdefault(h, []).append(x)
    leaders.clear()
    # By hash the groups that have it and their members; what only one set has, which is most, as that set alone.
    groups: dict[int, int | dict[int, list[int]]] = {}
    for x in order:
        tried: set[int] = set()
        for h in start[x]:
            here = groups.get(h)
            if here is None:
                groups[h] = x
                continue
            if isinstance(here, int):
                here = groups[h] = {leader[here]: [here]}
            for g, members in here.items():
                for y in members if top(g) != top(x) else ():
                    if y not in tried:
                        tried.add(y)
                        if joins(x, y):
                            break
            here.setdefault(leader[x], []).append(x)
    return found


def proposed(docs: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints are close or that share a band."""
    spread = rows.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    buckets = broadcast_if_small(spread.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select("band", "a"))
    by_band = spread.join(buckets, "band").where("a <> node").select("a", F.col("node").alias("b"))
    of = checkpointed(fingerprinted(docs).join(rows.groupBy("key").agg(F.first("node").alias("node")), "key").groupBy("fp").agg(F.min("node").alias("low"), F.collect_set("node").alias("nodes")))
    equal = of.where(F.size("nodes") > 1).select(F.col("low").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    close = simhash.links(of.select("fp"), radius)
    close = close.join(of.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return by_band.union(equal).union(close)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(key, fp) of the different texts."""
    return simhash.fingerprints(docs.select(text_key().alias("doc_id"), "text"), SHINGLE).select(F.col("doc_id").alias("key"), "fp").distinct()


def _compared(dealt: DataFrame, *keys: str) -> DataFrame:
    """Links (a, b) among the texts of each group of keys."""

    def solve(part: pa.Table) -> pa.Table:
        nodes = part.column("node").to_pylist()
        links = near([shingle_set(t.as_py() or b"") for t in part.column("text").cast(pa.large_binary())]) if len(nodes) > 1 else []
        trim()
        return pa.table({"a": pa.array([nodes[x] for x, _ in links], pa.int64()), "b": pa.array([nodes[y] for _, y in links], pa.int64())})

    return checkpointed(dealt.groupBy(*keys).applyInArrow(solve, "a long, b long"))


def verified(docs: DataFrame, rows: DataFrame, gathered: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between the nodes of one label whose texts are similar enough."""
    keys = rows.groupBy("node").agg(F.min("key").alias("key")).join(gathered, "node")
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(keys), "key")
    texts = texts.groupBy("key", "node", "label").agg(F.first("text").alias("text")).select("node", "label", "text")
    size = texts.groupBy("label").agg(F.ceil(F.sum(F.length("text")) / block_bytes).cast("int").alias("k"))
    texts = checkpointed(texts.join(broadcast_if_small(size), "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    found = _compared(texts, "label", "block")
    many = texts.where("k > 1")
    if many.isEmpty():
        return found
    # One text stands for each group that fills an eighth of a block or more, so there are at most eight a block.
    part = lambda links: many.join(connected_components(links).withColumnRenamed("label", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = part(found).groupBy("label", "block", "group").agg(F.min("node").alias("node"), F.sum(F.length("text")).alias("n")).where(8 * F.col("n") >= block_bytes)
    found = found.union(_compared(many.select("node", "label", "text").join(first.select("node"), "node", "left_semi"), "label"))
    # A link that is still missing has an end outside the label's largest group; those texts meet every block.
    grouped = checkpointed(part(found))
    largest = grouped.groupBy("label", "group").agg(F.sum(F.length("text")).alias("n")).groupBy("label").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    rest = grouped.join(broadcast_if_small(largest), "label")
    everywhere = F.when(F.col("group") == F.col("largest"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    others = rest.where("group <> largest").select("label").distinct()
    rest = rest.join(broadcast_if_small(others), "label", "left_semi").select("label", "node", "text", F.explode(everywhere).alias("block"))
    return found.union(_compared(rest, "label", "block"))


def groups(docs: DataFrame, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, row, label) for every row of docs; rows of a label are near copies."""
    rows = checkpointed(marked(docs))
    gathered = connected_components(proposed(docs, rows, radius))
    labels = connected_components(verified(docs, rows, gathered, block_bytes))
    slim = rows.select("doc_id", "key", "row", "node")
    return slim.join(broadcast_if_small(labels), "node", "left").select("doc_id", "key", "row", F.coalesce("label", "node").alias("label"))


def drop_copies(docs: DataFrame, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each group the row with the smallest id stays (rows without an id come last; then by the hashes of text and row)."""
    found = checkpointed(groups(docs, radius, block_bytes))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row")
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("label", "best")
    many = checkpointed(found.join(best, "label"))
    first = (F.col("key") == F.col("best.key")) & (F.col("row") == F.col("best.row"))
    # A row is told by its hashes; repeats of the row that stays are all told by the same ones.
    lost = broadcast_if_small(many.where(~first).select("key", "row").distinct())
    again = broadcast_if_small(many.where(first).groupBy("key", "row").agg(F.count("*").alias("n")).where("n > 1").select("key", "row"))
    # Names that no column of docs has, in any case of letters.
    key, row = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{w}{k}") not in {c.lower() for c in docs.columns}) for w in ("key", "row"))
    keyed = docs.withColumn(key, text_key()).withColumn(row, row_key(docs))
    same = lambda of: (keyed[key] == of["key"]) & (keyed[row] == of["row"])
    kept = keyed.join(lost, same(lost), "left_anti")
    single = kept.join(again, same(again), "left_anti")
    return single.union(kept.join(again, same(again), "left_semi").dropDuplicates([key, row])).drop(key, row)
