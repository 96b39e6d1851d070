"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns.  It belongs to its smallest member.  What a conversation owns is a suffix of
its path: whoever is the smallest member of a node is the smallest of the nodes below it on its own path.  So a subtree
needs no walk: every member adds the tokens of its path from the node on, less those of the nodes it owns, and a flag if it
owns the leaf where it ends; one aggregation by prefix gives the sums.

A prefix is known by the exclusive or of the hashes of its turns, each hashed with its depth (twice 64 bits), so prefixes are
running values.  Texts stay in the scan: a turn goes on as the MD5 of role and text and its number of code points.

No key is handled whole by one task.  Turns are numbered by a sort over ranges, in which a long conversation lies in many
partitions; running values are windows over stretches of `STRETCH` turns, carried on by the sums of the stretches;
the smallest member of a prefix is a partial aggregate that goes back to the rows by a join that treats frequent prefixes
apart (a window over the rows of the root would be one task).  Only the SHA-256 of the conversations that end in a node is
sequential by its nature: ids are sorted and joined in ranges first, so what one task streams is their text alone.

Defined results: a null conv_id is no conversation; a null role or text is empty; turns of one number are ordered by the MD5
of role and text, and repeated rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import broadcast_if_small, checkpointed, joined_by_key

#: Conversations that share a first one, and the most turns (plus one) that are taken from it.
SHARE, HEAD = 100, 6
#: Turns of a conversation that one window holds.
STRETCH = 4096
#: Characters of joined ids in a row.
JOINED = 1 << 18


def head_turns() -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, size): the turns in order, numbered from 1 in each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat_ws("\0", F.length(role).cast("string"), role, text)).alias("turn_hash"), F.length(text).cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_hash"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = checkpointed(dealt.select("conv_id", "turn_hash", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")))
    pieces = lined.groupBy("conv_id", "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = pieces.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lined.join(offset, ["conv_id", "part"]).select("conv_id", (F.col("line") + F.col("shift") + 1).alias("place"), "turn_hash", "size")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, turn_hash, size) of every turn of the rebuilt conversations, and their roots (depth 0)."""
    turns = checkpointed(numbered(conversations))
    heads = turns.where(F.col("place") < HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_hash", "size"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", head_turns())
    first = heads.select(F.col("conv_id").alias("base"), "head")
    known = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE).join(first, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(dict(heads.dtypes)["head"])), 1, F.col("h"))
    known = checkpointed(known.select("conv_id", "n", "h", taken.alias("taken")).withColumn("n_turns", F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    top = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("").alias("turn_hash"), F.lit(0).cast("long").alias("size")))
    begun = known.select("conv_id", "n_turns", F.explode(F.concat(top, "taken")).alias("t")).select("conv_id", F.col("t.place").alias("depth"), "n_turns", "t.turn_hash", "t.size")
    late = turns.where(F.col("place") > head_turns())
    rest = joined_by_key(late, known.select("conv_id", "n", "n_turns", (F.size("taken") - F.col("h")).alias("shift")), "conv_id")
    return begun.unionByName(rest.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "n_turns", "turn_hash", "size"))


def with_prefixes(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """With `node` (depth and both hashes of the prefix), `above` (that of the turn before) and `total` (code points up to it)."""
    hashed = turns.select("*", F.when(F.col("depth") > 0, F.xxhash64("depth", "turn_hash")).otherwise(0).alias("a"), F.when(F.col("depth") > 0, F.xxhash64("turn_hash", "depth")).otherwise(0).alias("b"), F.floor(F.col("depth") / stretch).alias("stretch"))
    upto = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = checkpointed(hashed.select("conv_id", "depth", "n_turns", "size", "a", "b", "stretch", F.bit_xor("a").over(upto).alias("x"), F.bit_xor("b").over(upto).alias("y"), F.sum("size").over(upto).alias("total")))
    sums = local.where(F.col("n_turns") >= stretch).groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "stretch", *(F.coalesce(f("a" if n == "x0" else "b" if n == "y0" else "size").over(before), F.lit(0)).alias(n) for n, f in (("x0", F.bit_xor), ("y0", F.bit_xor), ("t0", F.sum))))
    rows = local.join(broadcast_if_small(carried), ["conv_id", "stretch"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))) for c in ("x", "y"))
    node = F.struct("depth", x.alias("x"), y.alias("y"))
    above = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), x.bitwiseXOR(F.col("a")).alias("x"), y.bitwiseXOR(F.col("b")).alias("y")))
    return rows.select("conv_id", "depth", "n_turns", "size", node.alias("node"), above.alias("above"), (F.col("total") + F.coalesce("t0", F.lit(0))).alias("total"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], Iterator]]:
    """The values of the last column by node, which comes in the first three; rows of a node lie together."""
    rows = ((tuple(node), value) for batch in batches for *node, value in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for node, run in itertools.groupby(rows, key=lambda r: r[0]):
        yield node, (value for _, value in run)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 10_000, size: int = 16 * JOINED) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a string, as batches of bounded rows and characters."""
    held, chars = [], 0
    for row in itertools.chain(rows, [None]):
        if held and (row is None or len(held) >= most or chars > size):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, chars = [], 0
        if row is not None:
            held.append(row)
            chars += len(row[-1])


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): of the ids of the conversations that end in a node, ascending and joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for node, run in _runs(batches):
                ids, size = [], 0
                for conv_id in run:
                    ids.append(str(conv_id))
                    size += len(ids[-1]) + 1
                    if size > JOINED:
                        yield *node, int(ids[0]), ",".join(ids)
                        ids, size = [], 0
                if ids:
                    yield *node, int(ids[0]), ",".join(ids)

        yield from _batches(made(), ["depth", "x", "y", "first", "ids"], [pa.int64()] * 4 + [pa.string()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for node, run in _runs(batches):
                state = hashlib.sha256(next(run).encode())
                for ids in run:
                    state.update(b"," + ids.encode())
                yield *node, state.hexdigest()

        yield from _batches(made(), ["depth", "x", "y", "ends_sha256"], [pa.int64()] * 3 + [pa.string()])

    key = "depth long, x long, y long"
    last = checkpointed(rows.where("depth = n_turns").select("node.*", "conv_id"))
    order = ["depth", "x", "y", "conv_id"]
    parts = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{key}, first long, ids string")
    found = parts.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first").drop("first").mapInArrow(digests, f"{key}, ends_sha256 string")
    return found.select(F.struct("depth", "x", "y").alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = checkpointed(with_prefixes(rebuilt(conversations), stretch))
    owners = rows.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max(F.col("n_turns") > F.col("depth")).alias("inner"))
    marked = checkpointed(joined_by_key(rows, owners, "node"))
    # Of each conversation: where what it owns begins, the code points up to there, and whether it owns a leaf.
    owned = F.col("owner") == F.col("conv_id")
    of = marked.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.when(owned, F.col("depth"))).alias("begins"), F.max(F.when(~owned, F.col("total"))).alias("shared"), F.max((owned & (F.col("depth") == F.col("n_turns")) & ~F.col("inner")).cast("long")).alias("leaf"))
    told = joined_by_key(marked, of, "conv_id")
    mine = F.coalesce(F.col("depth") >= F.col("begins"), F.lit(False))
    child = (F.col("depth") < F.col("n_turns")) & F.coalesce(F.col("depth") + 1 >= F.col("begins"), F.lit(False))
    saved = F.when(mine, 0).otherwise(F.col("shared") - F.col("total") + F.col("size"))
    nodes = told.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    nodes = checkpointed(nodes)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = joined_by_key(nodes.where("above is not null"), parents, "above")
    top = nodes.where("above is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = below.unionByName(top).join(ends(rows), "node", "left")
    return found.select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
