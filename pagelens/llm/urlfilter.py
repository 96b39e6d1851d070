"""URL filters: a sorted array of 64-bit digests, probed by vectorised binary search, with the strings against collisions.

A list of blocked entries (a host, which covers its subdomains, or a host with the start of a path that ends at `/` or
with the path) becomes a file of sorted XXH64 digests, the entries in the same order and their offsets.  Spark ships
the file to every worker once; tasks map it into memory, look all keys of a batch up at once, and compare the strings
of the hits.  The keys of a URL are its host, each parent domain, and each of these with each directory and the path.

A list is cut by digest into shards of about `MAX_ENTRIES` entries, and the driver makes the files one after another, so it
holds one shard at a time.  Tasks map all of them (what is not probed stays on disk) and look a key up in its digest's
shard.  A worker keeps 16 bytes and the string of each entry on disk.

Rules (host, path) come first: a rule fits its host and all subdomains if the URL's path starts with the rule's; the
longest one that fits decides.  Otherwise a URL is blocked if one of its keys is in the list.

Defined results: host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path
what follows up to `?`, `#` or the end; a null URL or one without `://` has both empty and is allowed.  Null ids and
repeated rows keep their rows; null and repeated entries count once; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import checkpointed

MAX_ENTRIES = 2_000_000

#: The rules of the query, and a list of hosts that stand for spam, betting and tracking.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED = ["ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]


def digest(entry: bytes) -> int:
    """XXH64 with seed 42, as Spark's xxhash64 has it."""
    return xxhash.xxh64_intdigest(entry, seed=42)


class DigestArray:
    """Entries behind a memory-mapped sorted array of their digests; equal digests stand side by side."""

    MAGIC = b"DIGESTS1"

    @classmethod
    def write(cls, path: str | Path, entries: list[str]) -> None:
        sorted_entries = sorted({e.encode() for e in entries}, key=lambda e: (digest(e), e))
        digests = np.array([digest(e) for e in sorted_entries], "<u8")
        offsets = np.concatenate(([0], np.cumsum([len(e) for e in sorted_entries], dtype=np.int64))).astype("<i8")
        with open(path, "wb") as out:
            out.write(cls.MAGIC + len(sorted_entries).to_bytes(8, "little") + digests.tobytes() + offsets.tobytes() + b"".join(sorted_entries))

    def __init__(self, path: str | Path):
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != self.MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = int.from_bytes(data[8:16].tobytes(), "little")
        self.digests = data[16 : 16 + 8 * n].view("<u8")
        self.offsets = data[16 + 8 * n : 24 + 16 * n].view("<i8")
        self.strings = data[24 + 16 * n :]

    def contains(self, keys: list[bytes], probes: np.ndarray | None = None) -> np.ndarray:
        """Whether each key is an entry; the strings are compared only where the digests are equal."""
        probes = np.fromiter(map(digest, keys), np.uint64, len(keys)) if probes is None else probes
        found = np.zeros(len(keys), bool)
        if len(self.digests):
            at = np.searchsorted(self.digests, probes)
            for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probes).tolist():
                j = at[i]
                while not found[i] and j < len(self.digests) and self.digests[j] == probes[i]:
                    found[i] = self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]
                    j += 1
        return found


class Shards:
    """Several digest arrays; a key belongs to the one of its digest, as a signed number, modulo their number."""

    def __init__(self, paths: list[str]):
        self.arrays = [DigestArray(p) for p in paths]

    def contains(self, keys: list[bytes]) -> np.ndarray:
        probes = np.fromiter(map(digest, keys), np.uint64, len(keys))
        shard = probes.view(np.int64) % len(self.arrays)
        found = np.zeros(len(keys), bool)
        for k, array in enumerate(self.arrays):
            at = np.flatnonzero(shard == k)
            found[at] = array.contains([keys[i] for i in at.tolist()], probes[at])
        return found


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def keys_of(host: str, path: str) -> list[bytes]:
    """What an entry must equal to block a URL."""
    parts = host.split(".")
    hosts = [".".join(parts[i:]) for i in range(len(parts))] if host else []
    starts, at = [""], path.find("/")
    while at >= 0:
        starts.append(path[: at + 1])
        at = path.find("/", at + 1)
    if path and not path.endswith("/"):
        starts.append(path)
    return [f"{h}{s}".encode() for h in hosts for s in starts]


def _ship(spark: SparkSession, entries: list[str]) -> str:
    """The name under which every worker finds the digest array of the entries."""
    name = f"digests-{xxhash.xxh64_hexdigest(chr(0).join(sorted(set(entries))))}.bin"
    if name not in {Path(f).name for f in spark.sparkContext.listFiles}:
        folder = tempfile.mkdtemp(prefix="digests-")  # the driver's own; Spark serves the file to the workers from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        DigestArray.write(Path(folder) / name, entries)
        spark.sparkContext.addFile(str(Path(folder) / name))
    return name


def blocked_urls(urls: DataFrame, entries: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The rows of `urls` (with columns host and path) and a column `listed`."""
    spark = urls.sparkSession
    entries = checkpointed(entries.select(F.col("entry").cast("string").alias("entry")).where("entry is not null").distinct())
    n = max(1, -(-entries.count() // max_entries))
    shard = F.pmod(F.xxhash64("entry"), F.lit(n))
    names = [_ship(spark, [r["entry"] for r in entries.where(shard == k).toLocalIterator()]) for k in range(n)]  # about max_entries each
    columns = urls.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards([SparkFiles.get(name) for name in names])
        for batch in batches:
            keys, offsets = [], [0]
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                keys += keys_of(host or "", path or "")
                offsets.append(len(keys))
            hits = np.concatenate(([0], np.cumsum(shards.contains(keys))))
            listed = hits[np.array(offsets[1:], np.int64)] > hits[np.array(offsets[:-1], np.int64)] if len(batch) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed)], [*columns, "listed"])

    return urls.mapInArrow(probe, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in urls.schema)}, listed boolean")


def judge(pages: DataFrame, entries: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    if entries is None:
        entries = pages.sparkSession.createDataFrame([(e,) for e in BLOCKED], "entry string")
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    listed = blocked_urls(parts, entries, max_entries)
    found = fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return listed.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
