"""Benchmark decontamination with spaced seeds.

A token is a lower-cased word without the signs at its edges.  A mask such as 10101101 looks at the tokens under its
ones and ignores the others, so a seed still hits when an ignored token was substituted.  The seeds of all benchmark
items make a sorted table of hashes; the seeds of the documents are looked up in it.  Around each hit, on its diagonal
(document position minus item position), the aligned tokens are compared: a run is an overlap if it covers `MIN_TOKENS`
tokens (or the whole item, if that is shorter and has `MIN_ITEM` tokens or more) and `MIN_SHARE` of its tokens are equal.
The best run, by `MATCH` for an equal token and `MISS` for another, is reported if it is one; otherwise the longest run
between equal tokens that is.  A document is contaminated if it has an overlap.

The three masks lose no overlap: wherever the substitutions that `MIN_SHARE` allows stand in 8 to 25 tokens, one mask hits
(a test tries every placement), and a longer run can be cut into stretches of 13 to 25 tokens, one of which has this
share too.  Items of fewer than `MIN_ITEM` tokens, from `SHORTEST` on, overlap only where all their tokens stand.

A passage that many items and texts share costs one look for each text, item and diagonal: hits that follow from the one
before are left out, different diagonals are compared as arrays, and a bounded number of them is held.

The seed table goes to the tasks in blocks of at most `BLOCK_TOKENS` benchmark tokens, one pass over the documents for
each block, and each block's findings are written before the next is fetched, so what is sent and what the driver holds
have a fixed size however large the benchmark is.

Defined results: null and empty texts and items overlap nothing; items shorter than `SHORTEST` tokens say too little and
are not looked for; repeated items count under each of their ids; repeated documents and null doc_ids keep their rows; a
null item_id appears as a null in the list; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import Words, checkpointed, rows_in_arrow, slices, written

MASKS = ("10101101", "111101", "1100111")
MATCH, MISS = 1, -2
MIN_TOKENS, MIN_ITEM, SHORTEST, MIN_SHARE = 13, 8, 4, 0.8
BLOCK_TOKENS = 2_000_000
#: Hits, and places on diagonals, that are looked at together.
SPREAD = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets of the texts); words of signs only are left out."""
    words = Words(texts)
    clean = pc.replace_substring_regex(words.unique, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in clean), np.uint64, len(clean))[words.codes]
    keep = hashes != 0
    offsets = np.concatenate(([0], np.cumsum(keep)))[words.offsets]
    return hashes[keep], offsets


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed hash at each position (as many as the mask has room for)."""
    n = len(hashes) - len(mask) + 1
    mixed = np.full(max(0, n), number + 1, np.uint64)
    for i, sign in enumerate(mask):
        if sign == "1" and n > 0:
            mixed = (mixed ^ hashes[i : i + n]) * _PRIME
            mixed ^= mixed >> np.uint64(32)
    return mixed


@dataclass
class Index:
    """Benchmark items of a block: tokens end to end, and their seeds sorted by hash with their positions.

    `group` numbers the seeds of one hash, which begin at `first`; `after` has for each group the one that stands one token on
    from all of it and from nothing else.  A passage that many items share is a row of such groups.
    """

    ids: list[int | None]
    tokens: np.ndarray
    offsets: np.ndarray
    item: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    masks: tuple[str, ...]
    first: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS) -> Index:
        found, offsets = tokens(pa.array([t for _, t in items], pa.string()))
        item = np.repeat(np.arange(len(items)), np.diff(offsets))
        hashes, places, number = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.diff(offsets)
        whole = tuple("1" * n for n in range(SHORTEST, MIN_ITEM) if (sizes == n).any())
        for k, mask in enumerate(masks + whole):
            h = seeds(found, mask, k)
            at = np.arange(len(h))
            inside = (offsets[1:][item[at]] - at >= len(mask)) & (sizes[item[at]] >= MIN_ITEM if k < len(masks) else sizes[item[at]] == len(mask))
            hashes.append(h[inside])
            places.append(at[inside])
            number.append(np.full(inside.sum(), k))
        hashes, places, number = np.concatenate(hashes), np.concatenate(places), np.concatenate(number)
        order = np.argsort(hashes, kind="stable")
        hashes, places, number = hashes[order], places[order], number[order]
        first = np.flatnonzero(np.concatenate(([len(hashes) > 0], hashes[1:] != hashes[:-1])))
        size = np.diff(np.append(first, len(hashes)))
        group, follows = np.repeat(np.arange(len(first)), size), np.full(len(hashes), -1)
        for k in range(len(masks)):
            own = number == k
            at = np.full(len(found) + 1, -1)
            at[places[own]] = group[own]
            same = item[np.minimum(places[own] + 1, len(found) - 1)] == item[places[own]]
            follows[own] = np.where(same, at[places[own] + 1], -1)
        after = np.minimum.reduceat(follows, first) if len(first) else follows
        single = (after == np.maximum.reduceat(follows, first)) & (after >= 0) if len(first) else after >= 0
        single[single] &= size[after[single]] == size[single]
        return cls([i for i, _ in items], found, offsets, item, hashes, places, masks + whole, first, np.where(single, after, -1))

    def diagonals(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, item, diagonal), one for each text, item and diagonal with a hit.

        Where a hit follows from the one before it, on the same diagonals, only the first is looked at; seeds with many
        places are spread out a bounded number at a time.
        """
        rows = [np.zeros((0, 3), np.int64)]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        size = np.diff(np.append(self.first, len(self.hashes)))
        for k, mask in enumerate(self.masks):
            h = seeds(found, mask, k)
            if not len(h) or not len(self.hashes):
                continue
            low = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            at = np.flatnonzero((self.hashes[low] == h) & (offsets[1:][text[: len(h)]] - np.arange(len(h)) >= len(mask)))
            group = np.searchsorted(self.first, low[at])
            told = np.zeros(len(at), bool)
            told[1:] = (at[1:] == at[:-1] + 1) & (text[at[1:]] == text[at[:-1]]) & (self.after[group[:-1]] == group[1:])
            at, group = at[~told], group[~told]
            for a, b in pieces(size[group], SPREAD):
                many = size[group[a:b]]
                hit = np.repeat(at[a:b], many)
                place = self.places[np.repeat(self.first[group[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                item = self.item[place]
                row = np.stack((text[hit], item, (hit - offsets[text[hit]]) - (place - self.offsets[item])), axis=1)
                rows.append(unique_rows(row))
        return unique_rows(np.concatenate(rows))

    def runs(self, found: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(start in the text, tokens, equal tokens) for each row (text, item, diagonal), as `overlap` has it."""
        out = np.zeros((len(rows), 3), np.int64)
        text, item, diagonal = rows.T
        own, begin = np.diff(self.offsets)[item], np.maximum(0, diagonal)
        length = np.minimum(np.diff(offsets)[text], diagonal + own) - begin
        order = np.argsort(length, kind="stable")
        for a, b in pieces(length[order], SPREAD, level=True):
            part = order[a:b]
            wide = int(length[part].max(initial=0))
            if not wide:
                continue
            column, inside = np.arange(wide), np.arange(wide) < length[part, None]
            x = np.minimum((offsets[text[part]] + begin[part])[:, None] + column, len(found) - 1)
            y = np.minimum((self.offsets[item[part]] + begin[part] - diagonal[part])[:, None] + column, len(self.tokens) - 1)
            equal = (found[x] == self.tokens[y]) & inside
            blank = np.zeros((len(part), 1), np.int64)
            count = np.hstack((blank, np.cumsum(equal, axis=1)))
            gain = np.hstack((blank, np.cumsum(np.where(equal, MATCH, MISS), axis=1)))
            stop = np.argmax(gain - np.minimum.accumulate(gain, axis=1), axis=1)
            start = np.argmin(np.where(np.arange(wide + 1) <= stop[:, None], gain, 1 << 40), axis=1)
            row, need = np.arange(len(part)), np.minimum(MIN_TOKENS, own[part])
            equals = count[row, stop] - count[row, start]
            good = (stop - start >= need) & (equals >= MIN_SHARE * (stop - start))
            short = own[part] < MIN_ITEM
            whole = short & (length[part] == own[part]) & (count[row, -1] == own[part])
            out[part[good & ~short]] = np.stack((begin[part] + start, stop - start, equals), axis=1)[good & ~short]
            out[part[whole]] = np.stack((begin[part], own[part], own[part]), axis=1)[whole]
            # Of the others only those can hold an overlap in which some stretch is long and equal enough.
            worth = count - MIN_SHARE * np.arange(wide + 1)
            least = np.minimum.accumulate(worth, axis=1)
            back = np.arange(wide + 1) - need[:, None]
            likely = ((back >= 0) & (worth >= np.take_along_axis(least, np.maximum(back, 0), axis=1) - 1e-9)).any(axis=1)
            for i in part[likely & ~good & ~short].tolist():
                out[i] = self.overlap(found[offsets[text[i]] : offsets[text[i] + 1]], int(item[i]), int(diagonal[i]))
        return out

    def overlap(self, text_tokens: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int]:
        """(start in the text, tokens, equal tokens) of the run to report on a diagonal; no tokens if none is an overlap."""
        own = self.tokens[self.offsets[item] : self.offsets[item + 1]]
        begin, end = max(0, diagonal), min(len(text_tokens), diagonal + len(own))
        equal = text_tokens[begin:end] == own[begin - diagonal : end - diagonal]
        if len(own) < MIN_ITEM:
            whole = len(equal) == len(own) and equal.all()
            return begin, len(own) * whole, len(own) * whole
        gain = np.concatenate(([0], np.cumsum(np.where(equal, MATCH, MISS))))
        low = np.minimum.accumulate(gain)
        stop = int(np.argmax(gain - low))
        start = int(np.argmin(gain[: stop + 1]))
        need, count = min(MIN_TOKENS, len(own)), np.concatenate(([0], np.cumsum(equal)))
        if stop - start < need or count[stop] - count[start] < MIN_SHARE * (stop - start):
            # Longest run: for each start the last end whose worth (share above MIN_SHARE, times its length) is no less.
            starts, stops = np.flatnonzero(equal), np.flatnonzero(equal) + 1
            if not len(starts):
                return begin, 0, 0
            worth = count - MIN_SHARE * np.arange(len(count))
            after = np.maximum.accumulate(worth[stops][::-1])[::-1]
            last = np.searchsorted(-after, -worth[starts] + 1e-9, side="right") - 1
            best = int(np.argmax(stops[last] - starts))
            start, stop = int(starts[best]), int(stops[last[best]])
            if stop - start < need:
                return begin, 0, 0
        return begin + start, stop - start, int(count[stop] - count[start])


def pieces(sizes: np.ndarray, limit: int, level: bool = False) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose sizes add up to at most `limit` (one at least); `level` counts each as large as the run's last."""
    start = 0
    ends = np.cumsum(sizes)
    while start < len(sizes):
        if level:
            room = sizes[start:] * np.arange(1, len(sizes) - start + 1)
            stop = start + max(1, int(np.searchsorted(room, limit, side="right")))
        else:
            stop = max(start + 1, int(np.searchsorted(ends, limit + (ends[start - 1] if start else 0), side="right")))
        yield start, stop
        start = stop


def unique_rows(rows: np.ndarray) -> np.ndarray:
    """Different rows of small columns, sorted."""
    if not len(rows):
        return rows
    low = rows.min(axis=0)
    span = rows.max(axis=0) - low + 1
    if float(span[0]) * float(span[1]) * float(span[2]) >= 2**62:
        return np.unique(rows, axis=0)
    key = ((rows[:, 0] - low[0]) * span[1] + rows[:, 1] - low[1]) * span[2] + rows[:, 2] - low[2]
    return rows[np.unique(key, return_index=True)[1]]


def _blocks(items: DataFrame, block_tokens: int) -> list[DataFrame]:
    """The items in blocks of about `block_tokens` tokens."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_tokens))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _found(texts: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, run) of the overlaps of a slice: rows sorted by text, with start, tokens and equal tokens."""
    found, offsets = tokens(texts)
    rows = index.diagonals(found, offsets)
    runs = index.runs(found, offsets, rows)
    over = runs[:, 1] > 0
    return rows[over, 0], rows[over, 1], runs[over]


def _listed(n: int, index: Index, text: np.ndarray, item: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Overlaps as a list for each of n texts."""
    ids = pa.array(index.ids, pa.int64()).take(pa.array(item))
    values = pa.StructArray.from_arrays([ids, *(pa.array(runs[:, c], pa.int32()) for c in range(3))], ["item_id", "start", "tokens", "equal"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), values)


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For every row of docs: doc_id and its overlaps as an array of (item_id, start, tokens, equal)."""
    def search(block: DataFrame):
        index = Index.of([(r["item_id"], r["text"]) for r in block.collect()], masks)  # bounded by block_tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    names = [n for n in part.schema.names if n != "text"]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), _listed(len(part), index, *_found(part.column("text"), index))], [*names, "found"])

        return run

    schema = "doc_id long, found array<struct<item_id:long,start:int,tokens:int,equal:int>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(items, block_tokens)
    if len(blocks) == 1:
        return texts.mapInArrow(search(blocks[0]), schema)
    # The hash of a text keeps repeated ids apart while the blocks' findings are put together.
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), "text")
    parts = [checkpointed(texts.mapInArrow(search(b), schema.replace("found", "h long, found", 1)).where(F.size("found") > 0)) for b in blocks]
    one = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "h").agg(F.flatten(F.collect_set("found")).alias("found"))
    left = texts.select("doc_id", "h")
    return left.join(one, left.doc_id.eqNullSafe(one.doc_id) & left.h.eqNullSafe(one.h), "left").select(left.doc_id, F.coalesce(one.found, F.array().cast(schema.partition("found ")[2])).alias("found"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, longest) for every row."""
    best = F.aggregate("found", F.lit(0), lambda a, x: F.greatest(a, x["tokens"]))
    return overlaps(docs, items).select("doc_id", (F.size("found") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"]))).alias("item_ids"), best.alias("longest"))


def clean_documents(docs: DataFrame, items: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs whose own text is not contaminated, with all their columns and in any number; ids do not matter.

    Rows are decided where they are read, without a join; of several blocks, each is a pass over what the last one left.
    """

    def clean(block: DataFrame):
        index = Index.of([(r["item_id"], r["text"]) for r in block.collect()])  # bounded by block_tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    kept = np.ones(len(part), bool)
                    kept[_found(part.column("text"), index)[0]] = False
                    yield part.filter(pa.array(kept))

        return run

    blocks = _blocks(items, block_tokens)
    for i, block in enumerate(blocks):
        docs = rows_in_arrow(docs, clean(block))
        if i + 1 < len(blocks):
            docs = written(docs)
    return docs
