"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by two sorted dictionaries.

One edit leaves a half of a word intact.  With m code points in the shorter of two words, they share their first or their
last m // 2.  So every word enters a dictionary sorted forward and one sorted in reverse, once as the shorter word (m its
length) and once as a longer one (m its length less one), and only words of a block of shared prefix or suffix are compared.
A block of more than `BLOCK` words is subdivided by the same rule: what lies between the shared ends keeps its first or its
last half.  A block whose middle is one code point is as large as the alphabet allows and needs no further cut.

Each near pair belongs to one block: its path takes the prefix wherever the prefix is shared, else the suffix.  Blocks
are told apart by the path, so nothing is found twice and no pairs have to be made distinct.  A block gives one row for
each word that has a near word in it, not its pairs.

Defined results: null texts have no words; a null id is the empty text in front of the colon; repeated rows count as often
as they occur; ties of n go to the smallest word in code-point order; an empty table gives no rows; extra columns are
ignored.  Words of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import checkpointed, joined_by_key, trim

#: Fixed values of the task: letters of a run, the share of damaged runs, the least length and number of a word.
LETTERS, DAMAGED, SHORTEST, SELDOM = "[A-Za-zÀ-ÿ]+", 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that are compared with one another.
BLOCK = 48
FOUND = "word string, n_near long, top_n long, top string"


def words(docs: DataFrame, damaged: int = DAMAGED, shortest: int = SHORTEST, seldom: int = SELDOM) -> DataFrame:
    """(word, n): the words of all texts after one code point of every `damaged`-th run is taken out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(LETTERS), 0)).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seldom)


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry under the first and under the last half of its block's middle."""
    half = ((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    first = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.concat("path", F.lit("f")).alias("path"))
    last = F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), F.concat("path", F.lit("r")).alias("path"))
    return entries.select("word", "n", "m", F.explode(F.array(first, last)).alias("e")).select("word", "n", "m", "e.*")


def _keyed(entries: DataFrame) -> DataFrame:
    """With the block's name: the shared prefix, and the shared suffix in reverse.  The dictionaries are sorted by it."""
    prefix, suffix = F.substring("word", F.lit(1), F.col("p")), F.substring(F.reverse("word"), F.lit(1), F.col("s"))
    return entries.withColumn("key", F.concat_ws(" ", "m", "path", prefix, suffix))


def blocks(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, m, p, s, path, key) for every block of two words or more, subdivided until at most `block` are in it.

    `path` spells which halves were taken (f the first, r the last), `p` and `s` code points are shared in front and behind.
    """
    family = F.explode(F.array(F.length("word"), F.length("word") - 1))
    entries = _halves(vocabulary.select("word", "n", family.alias("m"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit("").alias("path")))
    done = None
    while True:
        entries = checkpointed(_keyed(entries))
        sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("m") - F.col("p") - F.col("s")).alias("middle")).where("n > 1")
        sized = checkpointed(joined_by_key(entries, sizes.select("key", "n", ((F.col("n") > block) & (F.col("middle") > 1)).alias("large")), "key"))
        whole = sized.where("not large").drop("large")
        done = whole if done is None else done.unionByName(whole)
        large = sized.where("large")
        if large.isEmpty():
            return done
        entries = _halves(large)


def edit(a: str, b: str, start: int) -> int:
    """The number of equal code points at the start of two words that differ by one edit; -1 for other words.

    The first `start` are known to be equal and a is not longer than b.
    """
    i, n = start, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    if n == len(b):
        return i if i < n and a[i + 1 :] == b[i + 1 :] else -1
    return i if a[i:] == b[i + 1 :] else -1


def path_of(m: int, shared: int, steps: int) -> str:
    """The halves that a pair takes which shares `shared` code points in front."""
    p, s, path = 0, 0, ""
    for _ in range(steps):
        half = (m - p - s) // 2
        if shared >= p + half:
            p, path = p + half, path + "f"
        else:
            s, path = s + half, path + "r"
    return path


def compared(rows: list[tuple[str, int]], m: int, p: int, path: str) -> dict[str, list]:
    """By word: the number of near words that are the block's, and the most frequent of them."""
    found: dict[str, list] = {}
    short = [r for r in rows if len(r[0]) == m]
    long = [r for r in rows if len(r[0]) > m]
    for i, (a, n) in enumerate(short):
        for b, k in (*short[i + 1 :], *long):
            shared = edit(a, b, p)
            if shared >= 0 and path_of(m, shared, len(path)) == path:
                for own, other in ((a, (-k, b)), (b, (-n, a))):
                    seen = found.setdefault(own, [0, other])
                    seen[0] += 1
                    seen[1] = min(seen[1], other)
    return found


def near(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, top_n, top): how many near words a word has, and the most frequent of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _scanned(batches):
            names, near_words = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[0] for x in near_words], pa.int64()), pa.array([-x[1][0] for x in near_words], pa.int64()), pa.array([x[1][1] for x in near_words], pa.string())], ["word", "n_near", "top_n", "top"])
        trim()

    sorted_ = blocks(vocabulary, block).repartitionByRange("key").sortWithinPartitions("key", "word")
    parts = sorted_.select("key", "word", "n", "m", "p", "path").mapInArrow(scan, FOUND)
    best = F.min(F.struct((-F.col("top_n")).alias("n"), F.col("top").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("top_n"), F.col("best.word").alias("top"))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """What each block of a sorted run of entries gives; of a run only the block in hand is held."""
    key, place, rows = None, (), []
    for batch in batches:
        for name, word, n, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != key:
                if len(rows) > 1 and (found := compared(rows, *place)):
                    yield found
                key, place, rows = name, where, []
            rows.append((word, n))
    if len(rows) > 1 and (found := compared(rows, *place)):
        yield found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last.  The steps double, so a few joins reach any end."""
    reached = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = step.drop("moved")
        if step.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for every word of the texts."""
    vocabulary = checkpointed(words(docs))
    found = vocabulary.join(near(vocabulary, block), "word", "left")
    follows = F.col("top_n") >= 2 * F.col("n")
    found = checkpointed(found.select("word", "n", F.when(follows, F.col("top")).alias("form"), F.when(follows, F.col("top_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
