"""Exact top-k inner products with MaxScore over the components of integer vectors.

A term is a component of the query; a posting list of a shard holds that component of every vector, as an impact that
is never negative: the distance from the shard's smallest value if the query's component is positive, else from its
largest.  So a vector's score is a constant of the query and shard plus the sum over terms of |q| times impact, and
|q| times the list's largest impact bounds a term.  Terms are sorted by bound; the longest run of small ones whose
bounds together stay below the threshold is non-essential.  Essential lists are traversed first; the others are
probed in turn, only for the vectors whose score so far plus the bounds of what is left still reaches the threshold.

A query's first threshold is the k-th best score among `seeds` candidates, found in Spark for all queries at once, so
nothing is lost.  Queries then go in blocks of about `block` components to every shard of the candidates (a Spark
partition's batches): the driver holds one block at a time, and each block's best rows are written before the next is
fetched, so what is held and sent has a fixed size.  The work is that of every query against every candidate's essential
terms, as the task states it.  Shards give back k rows a query at most, which a window merges.

Arithmetic is exact: components are integers held as doubles; sums that could leave 53 bits are taken in 64-bit integers,
and those that could leave these in Python's.  A score outside a long is given, and ranked, as the nearest long.

Defined results: vectors that are null, empty, or hold null or non-finite components (before or after scaling) take no
part; vectors of another length than the query's are no candidates for it; rows with a query's own id are no candidates;
candidates that repeat count row by row; a query row that occurs several times is one query (different vectors under one
id are several); ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import checkpointed

BLOCK = 1 << 20
SEEDS = 4096
SHARD = 8192
#: Non-essential terms that are probed between two looks at who is still competitive.
PROBE = 8
#: Components from which on a vector is kept apart, so that others stay in fast arithmetic.
HUGE = 2.0**31
LONG = 1 << 63


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x), x as double; the integers are held as doubles."""
    v = F.transform(F.col(vector_column), lambda x: _floor(x.cast("double") * scale))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.size(vector_column) > 0).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(sound).where("vec_id is not null")


def _floor(x: Column) -> Column:
    """The floor as a double; from 2 ** 52 on every double is whole."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


class Shard:
    """Posting lists of some vectors of one length: row d holds component d of all, in `ids` order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.floats = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.floats.min(1), self.floats.max(1)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))
        self.other: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def exact(self, query: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, lists, low and high in the narrowest numbers in which no sum can go wrong."""
        most = 2.0 * float(np.abs(query) @ self.most)
        if most < 2.0**52:
            return query, self.floats, self.low, self.high
        kind = "int" if most < 2.0**61 and float(self.most.max()) < 2.0**61 and float(np.abs(query).max()) < 2.0**61 else "object"
        as_kind = (lambda x: x.astype(np.int64)) if kind == "int" else np.vectorize(int, otypes=[object])
        if kind not in self.other:
            self.other[kind] = tuple(as_kind(x) for x in (self.floats, self.low, self.high))
        return as_kind(query), *self.other[kind]

    def top(self, query: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the best k that reach the threshold, best first, ties to the smaller id."""
        weights, lists, low, high = self.exact(query)
        bound = abs(weights) * (high - low)
        order = np.argsort(-bound, kind="stable")
        weights, low, high = weights[order], low[order], high[order]
        # What a term adds at least and at most.
        least, most = np.where(weights >= 0, weights * low, weights * high), np.where(weights >= 0, weights * high, weights * low)
        after = lambda x: np.concatenate((np.cumsum(x[::-1])[::-1], [0]))
        left, rest, certain = after(bound[order]), after(most), after(least)
        essential = len(order) if threshold is None or threshold <= -LONG else int(np.searchsorted(-left, certain[0] - threshold, side="right"))
        essential = min(max(essential, 1), len(order))
        score = weights[:essential] @ lists[order[:essential]]
        at = np.flatnonzero(self.ids != own)
        score = score[at]
        for i in range(essential, len(order), PROBE):
            if threshold is not None and threshold > -LONG:
                stay = score + rest[i] >= threshold
                at, score = at[stay], score[stay]
            if len(at) > k:  # the k-th best of what is certain raises the threshold
                floor = min(int(np.partition(score, len(score) - k)[len(score) - k] + certain[i]), LONG - 1)
                threshold = floor if threshold is None else max(threshold, floor)
            terms = order[i : i + PROBE]
            score = score + weights[i : i + PROBE] @ lists[np.ix_(terms, at)]
        if threshold is not None and threshold > -LONG:
            stay = score >= threshold
            at, score = at[stay], score[stay]
        score = np.array([min(max(x, -LONG), LONG - 1) for x in score.tolist()] if score.dtype == object else score, np.int64)
        if len(at) > 4 * k:
            stay = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[stay], score[stay]
        best = np.lexsort((self.ids[at], -np.maximum(score, 1 - LONG)))[:k]
        return at[best], score[best]


def _shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[Shard]:
    """Shards of at most `size` vectors each, by length of vector; vectors with huge components apart from others."""
    for batch in batches:
        ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        offsets = vectors.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, lengths = offsets - offsets[0], np.diff(offsets)
        kind = 2 * lengths + (np.maximum.reduceat(np.abs(flat), offsets[:-1]) >= HUGE) if len(ids) else lengths
        for n in np.unique(kind).tolist():
            rows = np.flatnonzero(kind == n)
            for i in range(0, len(rows), size):
                some = rows[i : i + size]
                yield Shard(ids[some], flat[offsets[some][:, None] + np.arange(n // 2)])


def _seeded(sample: list[pa.RecordBatch], k: int):
    """Adds to each query row the k-th best score among the sample, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = list(_shards(iter(sample)))
        for batch in batches:
            found = []
            for query_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                vector = v.values.to_numpy(zero_copy_only=False)
                scores = np.concatenate([s.top(vector, query_id, k, None)[1] for s in shards if len(s.floats) == len(vector)] or [np.zeros(0, np.int64)])
                found.append(int(np.sort(scores)[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "threshold"])

    return run


def _answer(queries: list[tuple[int, int, np.ndarray, int | None]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            out: list[list] = [[], [], [], []]
            for key, query_id, vector, threshold in queries:
                if len(vector) != len(shard.floats):
                    continue
                at, scores = shard.top(vector, query_id, k, threshold)
                for column, values in zip(out, ([key] * len(at), [query_id] * len(at), shard.ids[at].tolist(), scores.tolist()), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, v) of `queries` against those of `candidates`."""
    schema = "key long, query_id long, vec_id long, score long"
    asked = queries.select("vec_id", "v").distinct().withColumn("key", F.xxhash64("vec_id", "v"))
    sample = candidates.limit(seeds).toArrow().to_batches() if seeds else []  # bounded by `seeds`
    asked = checkpointed(asked.mapInArrow(_seeded(sample, k), "vec_id long, v array<double>, key long, threshold long"))
    blocks = -(-(asked.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0) // block) or 1
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    parts = []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).toArrow()  # about `block` components
        some = [(key, query_id, v.values.to_numpy(zero_copy_only=False), t) for key, query_id, v, t in zip(rows.column("key").to_pylist(), rows.column("vec_id").to_pylist(), rows.column("v"), rows.column("threshold").to_pylist(), strict=True)]
        found = candidates.mapInArrow(_answer(some, k), schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(checkpointed(found) if blocks > 1 else found)
    return reduce(DataFrame.unionAll, parts).select("query_id", "rank", "vec_id", "score")
