"""Length-delimited binary records of token ids, with masked checksums and an offset index.

A record frames one serialized sequence: its length in bytes (unsigned 64 bits), the masked CRC-32C of these eight bytes,
the sequence, and its masked CRC-32C, all little-endian.  A sequence is a document's ids as unsigned integers of 2 bytes
(4 if the vocabulary needs them), then the end id.

`write` orders the documents by id, deals them over files by ranges of the order and encodes and frames each range in one
pass; texts are shuffled once and ids never.  Each attempt of a task writes a file of its own.  The offset index is a
Parquet table that Spark commits, and it names the files of the attempts that won, so files of lost executors or repeated
tasks are left unread.  `read` needs the index only and works in any order; neighbouring records are fetched
together, and every checksum is verified.  `shuffled` puts the index in a random order for reading.

Defined results: a null text counts as empty, and an empty one is the end id alone; null ids come first; rows of one id are
in the order of the input; extra columns are ignored; an empty table writes no
file and an empty index.  A text is encoded a stretch at a time, however long it is; a record is held whole by the task
that writes or reads it.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.common import broadcast_if_small, checkpoint_folder, slices, trim
from pagelens.llm.tokens import id_width, shared_ids, vocabulary

#: The polynomial of CRC-32C, reflected, and what its mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes around a sequence.
HEAD, TAIL = 12, 4
#: The id that ends a document.
END = 2
#: Bytes that are framed or fetched at a time.
CHUNK = 4 << 20
INDEX = "doc_id long, file string, shard int, shard_start long, offset long, length long, width int"


def _shift_tables() -> list[np.ndarray]:
    """Tables that carry a checksum over 4, 8, 16, ... zero bytes, one row for each of its bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    columns = [one]
    for _ in range(3):
        columns.append(one[columns[-1] & 255] ^ (columns[-1] >> 8))
    tables = [np.stack(columns[::-1])]
    while len(tables) < 40:
        tables.append(_by_bytes(tables[-1], tables[-1]))
    return tables


def _by_bytes(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return table[0][sums & 255] ^ table[1][(sums >> 8) & 255] ^ table[2][(sums >> 16) & 255] ^ table[3][sums >> 24]


@functools.lru_cache(maxsize=None)
def _halves(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of a level with a row for each half of a checksum, which needs half the look-ups."""
    low, table = np.arange(1 << 16), _SHIFTS[level]
    return table[0][low & 255] ^ table[1][low >> 8], table[2][low & 255] ^ table[3][low >> 8]


def _carried(level: int, sums: np.ndarray) -> np.ndarray:
    """Checksums carried over 4 << level zero bytes."""
    first, second = _halves(level)
    halves = np.ascontiguousarray(sums, "<u4").view("<u2")
    return first[halves[0::2]] ^ second[halves[1::2]]


def _lead() -> bytes:
    """The four bytes that take a checksum from zero to its first state, all ones."""
    state = 0xFFFFFFFF
    for _ in range(32):
        state = (((state ^ POLYNOMIAL) << 1) | 1 if state >> 31 else state << 1) & 0xFFFFFFFF
    return struct.pack("<I", state)


_SHIFTS, _LEAD = _shift_tables(), _lead()


def crc32c(texts: list[bytes]) -> np.ndarray:
    """The CRC-32C of each text.  All are folded at once: four bytes each, then pairs of neighbours until one is left."""
    if not texts:
        return np.zeros(0, np.uint32)
    words = _carried(0, np.frombuffer(b"".join(bytes(-len(t) % 4) + _LEAD + t for t in texts), "<u4"))
    sizes = np.array([(len(t) + 7) // 4 for t in texts])
    level = 0
    while (sizes > 1).any():
        starts = np.concatenate(([0], np.cumsum(sizes[:-1])))
        words = np.insert(words, starts[sizes % 2 == 1], 0)
        sizes = (sizes + 1) // 2
        words = _carried(level, words[0::2]) ^ words[1::2]
        level += 1
    return words ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    return ((sums >> 15) | (sums << 17)) + np.uint32(MASK)


def framed(sequences: list[bytes]) -> Iterator[bytes]:
    lengths = [struct.pack("<Q", len(s)) for s in sequences]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(sequences)).astype("<u4")
    for length, head, sequence, tail in zip(lengths, heads, sequences, tails, strict=True):
        yield b"".join((length, head.tobytes(), sequence, tail.tobytes()))


def unframed(records: list[bytes]) -> list[bytes]:
    """The sequences of records, or an error for one that is not as it was written."""
    sequences = [r[HEAD:-TAIL] for r in records]
    for record, own in zip(records, framed(sequences), strict=True):
        if record != own:
            raise ValueError("a record's length or checksum is wrong")
    return sequences


def store(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match("file:|/", path):
        return pa_fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pa_fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, end: int = END, tokenizer_file: str | None = None) -> DataFrame:
    """Write records and index into a shared folder that does not exist yet; the index is returned as read."""
    spark, file = docs.sparkSession, vocabulary(tokenizer_file)
    places, inside = store(f"{folder}/records")
    places.create_dir(inside, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, width = TaskContext.get(), id_width(file)
        ids, last = shared_ids(file, width), end.to_bytes(width, "little")
        name, out, offset, tokens = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec", None, 0, 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                where = store(f"{folder}/records/{name}")
                out = out or where[0].open_output_stream(where[1])
                sequences = [ids.of(t or "") + last for t in part.column("text").to_pylist()]
                rows = []
                for record in framed(sequences):
                    out.write(record)
                    rows.append((name, task.partitionId(), tokens, offset, len(record), width))
                    offset += len(record)
                    tokens += (len(record) - HEAD - TAIL) // width
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], [c.split()[0] for c in INDEX.split(", ")])
        if out:
            out.close()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Without the text in the order, the ranges are found by a pass over the ids alone.
    order = [F.col("doc_id").asc_nulls_first(), "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, start, offset, length, width) of a folder's records; `start` counts the ids of all records before one."""
    table = spark.read.schema(INDEX).parquet(f"{folder}/index")
    sizes = table.groupBy("shard").agg(F.sum((F.col("length") - HEAD - TAIL) / F.col("width")).cast("long").alias("n"))
    # One row for each file, so a single task sees few.
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return table.join(broadcast_if_small(before), "shard").select("doc_id", F.concat(F.lit(f"{folder}/records/"), "file").alias("file"), (F.col("before") + F.col("shard_start")).alias("start"), "offset", "length", "width")


def shuffled(index: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of an index in a random order."""
    return index.orderBy(F.xxhash64(F.lit(seed), "start"))


def read(index: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, start, ids) for each row of an index, in its order; `ids` are unsigned 32-bit integers, little-endian.

    With `digests` their number and CRC-32 (n_tokens, ids_crc32) stand in their place.
    """
    kinds = {"n_tokens": pa.int64(), "ids_crc32": pa.int64()} if digests else {"ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "width")), strict=True))
            for first, stop in together(rows):
                path, begin = rows[first][:2]
                if path not in opened:
                    for file in opened.values():
                        file.close()
                    places, inside = store(path)
                    opened = {path: places.open_input_file(inside)}
                data = opened[path].read_at(rows[stop - 1][1] + rows[stop - 1][2] - begin, begin)
                sequences = unframed([data[at - begin : at - begin + n] for _, at, n, _ in rows[first:stop]])
                wide = [np.frombuffer(s, f"<u{r[3]}").astype("<u4").tobytes() for s, r in zip(sequences, rows[first:stop], strict=True)]
                part = batch.slice(first, stop - first)
                told = [[len(w) // 4 for w in wide], list(map(zlib.crc32, wide))] if digests else [wide]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), *map(pa.array, told, kinds.values())], ["doc_id", "start", *kinds])
        for file in opened.values():
            file.close()
        trim()

    return index.mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def together(rows: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of rows that lie behind one another in one file, of at most CHUNK bytes or one record."""
    first = size = 0
    for i, (path, offset, length, _) in enumerate(rows):
        if i > first and (path != rows[i - 1][0] or offset != rows[i - 1][1] + rows[i - 1][2] or size + length > CHUNK):
            yield first, i
            first, size = i, 0
        size += length
    if rows:
        yield first, len(rows)


def round_trip(docs: DataFrame, digests: bool = False) -> DataFrame:
    """Write the documents into a new folder beside the session's checkpoints and read every record back."""
    return read(write(docs, f"{checkpoint_folder(docs.sparkSession)}/records-{uuid.uuid4().hex}"), digests)
