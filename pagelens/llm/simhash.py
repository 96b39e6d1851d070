"""SimHash near-duplicate groups through vantage-point trees over Hamming distance.

Fingerprints: A-Z lower-cased, words split at ASCII white space, shingles of `shingle` words (repeats count; fewer
words: the whole sequence; none, or a null text: fingerprint zero), XXH64 with seed 42 of each, majority bit by bit.

Links: every pair of different fingerprints at most `radius` bits apart.  A tree of vantage points built from a
bounded sample deals the distinct fingerprints over shards: a node keeps those within its median distance inside and
the others outside; a fingerprint outside, but within `radius` of the boundary, is also sent inside as a copy, because
by the triangle inequality only those can have a partner there.

Every level sends about a third of a node to both sides, so this tree has `LEVELS` levels however large the table is.
Its shards are cut further by a rule that costs a constant number of copies: of `radius` + 1 parts of a fingerprint's
bits one is equal in both partners, so a shard is dealt `radius` + 1 times, by each part's value.  If pieces would still
be larger than `SHARD`, the other bits are parted once more by the same rule.  Each piece continues the tree in numpy
down to small blocks, which are compared exactly, and gives back a spanning forest of its links (never all pairs of a
group).  A fingerprint has therefore at most (1 + radius) ** 2 times 1.9 copies on average, whatever the size.

A crowd of fingerprints around one vantage point is joined to it at once; of the others only those within twice the
radius can be linked to the crowd.  Pieces beyond `CROWD` fingerprints, which only a crowd of so many different ones
makes, are compared as pairs of blocks of this size.

Defined results: equal texts share a fingerprint and need no link; null doc_ids keep their row and take part in
linking, but never name a group (component_id is null if a group has no other id); repeated rows stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import broadcast_if_small, checkpointed, joined_by_key, trim
from pagelens.llm.components import connected_components

#: Fingerprints that the driver looks at to place the vantage points, at most, and levels of the tree that deals.
SAMPLE, LEVELS = 16_384, 2
#: Fingerprints that a piece should get, and from how many on it is compared in blocks.
SHARD, CROWD = 24_000, 1_000_000
#: Pairs that one exact comparison covers at once.
PAIRS = 1 << 21


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority fingerprint of one text as an unsigned 64-bit integer."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(joined)]))
    if len(starts) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 15):
        cut = map(slice, starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist())
        hashes = np.fromiter(map(digest, map(joined.__getitem__, cut)), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A top tree as plain arrays; node i splits at distance `mu[i]` from `vantage[i]`, or is leaf `leaf[i]`."""

    def __init__(self, sample: np.ndarray, total: int, radius: int, shard: int = SHARD, levels: int = LEVELS):
        self.radius, self.vantage, self.mu, self.inside, self.outside, self.leaf, self.sizes = radius, [], [], [], [], [], []
        self._grow(sample, total / max(1, len(sample)), shard, levels)
        #: Fingerprints that the largest leaf gets, about, copies included.
        self.largest = max(self.sizes) * 1.4**levels

    def _grow(self, part: np.ndarray, weight: float, shard: int, levels: int) -> int:
        node = len(self.vantage)
        for x in (self.vantage, self.mu, self.inside, self.outside, self.leaf):
            x.append(-1)
        distance = np.bitwise_count(part ^ part[len(part) // 2]) if len(part) else part
        cut = int(np.median(distance)) if len(part) else 0
        near = distance <= cut
        if len(part) * weight <= shard or len(part) < 8 or not levels or near.all():
            self.leaf[node] = len(self.sizes)
            self.sizes.append(len(part) * weight)
            return node
        self.vantage[node], self.mu[node] = int(part[len(part) // 2]), cut
        self.inside[node] = self._grow(part[near], weight, shard, levels - 1)
        self.outside[node] = self._grow(part[~near], weight, shard, levels - 1)
        return node

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions, own): where each fingerprint goes; own is False for copies from across a boundary."""
        todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], at, own
                continue
            distance = np.bitwise_count(fps[at] ^ np.uint64(self.vantage[node])).astype(np.int16)
            cut = self.mu[node]
            into = distance <= cut + self.radius
            out = np.where(own, distance > cut, distance > cut - self.radius)
            todo.append((self.inside[node], at[into], (own & (distance <= cut))[into]))
            todo.append((self.outside[node], at[out], own[out]))

    def deal(self, fps: np.ndarray, shard: int = SHARD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(leaf and part, its piece, position, own): the leaves cut by the values of parts of the bits."""
        whole = (1 << 64) - 1
        parts = parts_of(whole, self.radius + 1)
        plan = [(m,) for m in parts]
        # Values of a part are spread over pieces: eight of them a piece at least, so that pieces are of like size.
        if self.largest > shard * min(map(values_of, parts)) / 8:
            plan = [(m, n) for m in parts for n in parts_of(whole & ~m, self.radius + 1)]
        if self.largest <= shard:
            plan = [()]
        pieces = max(1, round(self.largest / shard))
        for leaf, at, own in self.route(fps):
            for k, masks in enumerate(plan):
                value = np.full(len(at), k, np.uint64)
                for m in masks:
                    value = mixed(value ^ (fps[at] & np.uint64(m)))
                yield leaf * len(plan) + k, (value % np.uint64(pieces)).astype(np.int32), at, own


def parts_of(mask: int, n: int) -> list[int]:
    """The set bits of a mask in n runs of like length, as masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << b for b in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def values_of(mask: int) -> int:
    return 1 << mask.bit_count()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Forest:
    """Union of positions by smallest root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def link_shard(fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links in a shard that connects all pairs within `radius` of which one is the shard's own."""
    forest = Forest(len(fps))

    def compare(some: np.ndarray, others: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(others)))
        for i in range(0, len(some), step):
            block = some[i : i + step]
            x, y = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[others][None, :]) <= radius)
            forest.join(block[x], others[y])

    todo = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while todo:
        mine, copies = todo.pop()
        if not len(mine):
            continue
        both = np.concatenate((mine, copies))
        if len(mine) * len(both) <= PAIRS or len(mine) <= 64:
            compare(mine, both)
            continue
        vantage = mine[len(mine) // 2]
        distance = np.bitwise_count(fps[both] ^ fps[vantage]).astype(np.int16)
        own_distance, copy_distance = distance[: len(mine)], distance[len(mine) :]
        near = both[distance <= radius]
        forest.join(near, np.full(len(near), vantage))
        cut = int(np.median(own_distance))
        if cut <= 2 * radius and 16 * (own_distance <= radius).sum() >= len(mine):  # a crowd: its members are joined, and only what lies within twice the radius can reach them
            compare(both[(distance > radius) & (distance <= 2 * radius)], near)
            todo.append((mine[own_distance > radius], copies[copy_distance > radius]))
            continue
        inside = own_distance <= cut
        if inside.all():
            compare(mine, both)
            continue
        crossing = mine[~inside & (own_distance <= cut + radius)]
        todo.append((mine[inside], np.concatenate((copies[copy_distance <= cut + radius], crossing))))
        todo.append((mine[~inside], copies[copy_distance > cut - radius]))
    linked = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[linked], fps[forest.root[linked]]


def links(nodes: DataFrame, radius: int = 4, shard: int = SHARD, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all fingerprints in `nodes` (column fp, distinct) within `radius` of one another."""
    total = nodes.count()
    picked = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Tree(picked, total, radius, shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for leaf, piece, at, own in tree.deal(fps, shard):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(piece), pa.array(fps[at].view(np.int64)), pa.array(own)], ["leaf", "piece", "fp", "own"])

    def solve(piece: pa.Table) -> pa.Table:
        fps = piece.column("fp").to_numpy().view(np.uint64)
        a, b = link_shard(fps, piece.column("own").to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "leaf int, piece int, fp long, own boolean")
    crowded = dealt.groupBy("leaf", "piece").agg(F.ceil(F.count("*") / crowd).cast("int").alias("k")).where("k > 1")
    crowded = broadcast_if_small(crowded)
    k = F.coalesce("k", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), k).cast("int")
    dealt = dealt.join(crowded, ["leaf", "piece"], "left").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    dealt = dealt.select("leaf", "piece", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "own")
    return dealt.groupBy("leaf", "piece", "i", "j").applyInArrow(solve, "a long, b long")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id of its group."""
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    labels = checkpointed(connected_components(links(nodes.select("fp"), radius)))
    linked = nodes.join(labels, nodes.fp == labels.node).select("fp", "first_id", "label")
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    group = joined_by_key(linked.select("fp", "label"), smallest, "label").select("fp", F.col("component_id").alias("reached"))
    # Fingerprints without a link name their own group.
    group = nodes.join(group, "fp", "left").select("fp", F.least("first_id", "reached").alias("component_id"), "n")
    return joined_by_key(fps, group, "fp").select("doc_id", "fp", "component_id")
