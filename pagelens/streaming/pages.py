"""Streams of captures: detection batch by batch, a result cache within a watermark, and a rate limiter with state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions import urls
from pagelens.operators import matching, scoring


def once_per_page(captures: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """The first capture of each cache key within the watermark."""
    keyed = captures.withColumn("cache_key", urls.cache_key(F.col("final_url"), with_query=False))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["cache_key"])


def detect_stream(captures: DataFrame, rules: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the detections of each micro-batch as Parquet; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        found = scoring.detect(matching.core_evidence(batch, rules))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def limit_stream(hits: DataFrame, most: int = 30, seconds: int = 60, late: int = 600) -> DataFrame:
    """Hits (key, at) in order of time with the number of the key's known hits in the last `seconds`.

    The state is the sorted times of one window before the key's newest hit, so a hit that comes late in a later batch is
    counted among those that are still known.  Hits behind the watermark (`late` seconds) are dropped, and a key whose
    newest hit lies two windows behind it is forgotten.
    """
    span = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = sorted(state.get[0]) if state.exists else []
        rows = []
        for at in sorted(t for b in batches for t in b["at"]):
            micros = int(at.value // 1000)
            bisect.insort(recent, micros)
            n = bisect.bisect_right(recent, micros) - bisect.bisect_right(recent, micros - span)
            rows.append((key[0], at, n, n > most))
        state.update((recent[bisect.bisect_right(recent, recent[-1] - span) :] if recent else [],))
        state.setTimeoutTimestamp(max(recent[-1] // 1000 + 1000 + 2000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "at", "recent", "limited"])

    kind = dict(hits.dtypes)["key"]
    # A watermark starts at the epoch, which is no hit's lateness; hence the second.
    marked = hits.select("key", "at", (F.col("at") + F.expr("interval 1 second")).alias("mark")).withWatermark("mark", f"{late} seconds")
    return marked.groupBy("key").applyInPandasWithState(step, f"key {kind}, at timestamp, recent long, limited boolean", "recent array<long>", "append", "EventTimeTimeout")
