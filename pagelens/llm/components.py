"""Connected components by alternating large-star and small-star steps, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import checkpointed


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From links (a, b) of longs to rows (node, label) for each node with a link; label is the smallest node reached.

    Null ends and self links are dropped.  A hub's links are never gathered in one place: each step is a partial
    minimum followed by a join whose one side has a single row for each key, so adaptive execution can split a hub.
    """
    edges = checkpointed(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    seen = _signature(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
