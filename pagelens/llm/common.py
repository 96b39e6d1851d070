"""What the corpus operators share: Arrow word splitting, bounded slices, checkpoints and the held-out rule."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a Python task looks at (one row at least).
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's text modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def held_out() -> Column:
    return F.coalesce(remainder() == 0, F.lit(False))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local session without one gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagelens-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder, for what is too large for a checkpoint."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A checkpointed table, marked for broadcast if it has at most `rows` rows; else Spark joins it as it sees fit."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, hot: int = 100_000, small: int = 1_000_000) -> DataFrame:
    """Inner join with a table that has one row for each key, and in `n` the number of rows that the key has in `rows`.

    A table of at most `small` rows is broadcast.  Of a larger one the keys with `hot` rows or more are, which are at
    most a `hot`-th of `rows`; the others are joined by a shuffle, in which no key is large any more.
    """
    table = checkpointed(table)
    if table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table.drop("n")), key)
    often = F.broadcast(table.where(F.col("n") >= hot).drop("n"))
    seldom = rows.join(often.select(key), key, "left_anti").join(table.where(F.col("n") < hot).drop("n"), key)
    return rows.join(often, key).unionByName(seldom)


def rows_in_arrow(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`docs.mapInArrow(run, docs.schema)` for columns of any name; `text` and other plain names stay what they are."""
    names = [c if re.fullmatch(r"\w+", c) else f"_column{i}_" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Hand texts to Python in batches of at most `rows` rows from now on, so workers hold less at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, rows)


def trim() -> None:
    """Give memory that a task no longer uses back, so that workers that live long stay small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows with at most `limit` bytes in `column` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


class Words:
    """The white-space separated words of a slice of texts, lower-cased, with equal words stored once.

    `codes[offsets[i]:offsets[i + 1]]` are the words of text i as positions in `unique`.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "")
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.unique: pa.Array = coded.dictionary
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.n_texts = len(texts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.offsets))


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings end to end, and where each starts (one more than strings)."""
    strings = pa.concat_arrays([strings.cast(pa.large_string())])
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if len(strings) and strings.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sum_by_segment(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; empty segments give zero."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def max_by_segment(values: np.ndarray, offsets: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Largest of values[offsets[i]:offsets[i + 1]]; empty segments give `empty`."""
    out = np.full(len(offsets) - 1, empty, np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[full])
    return out
