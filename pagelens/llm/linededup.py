r"""Line dedup with a log-template tree of fixed depth, as joins and aggregations.

A line's words are what stands between blanks and tabs.  Words with a digit are variable and become `<*>`, unless they
are more than half of the line, which then keeps its own words: the line's masked form.  The tree's levels are the number
of words and the first `DEPTH` words, so a leaf holds lines that agree in these.  A leaf has any number of templates: the
words behind the leading ones are cut into `SEGMENTS` stretches of like length, and a template generalises one or two of
them as variable fields and keeps the others, which have to be at least `STATIC` of those words.  A line therefore
belongs to its own masked form and, from `DEPTH + TAIL` words on, to each template of its leaf that it fits; which lines
share a template depends neither on what else is in the leaf nor on which value of a field is the commonest.

A template that occurs in `MIN_DOCS` documents, or one of at least `LONG` words that occurs in two, is recurring.  The
document with the smallest id keeps its lines; a line goes if one of its recurring templates occurs in an earlier
document.  So a template's first occurrence stays, and copies of a document lose what the first one has.

Work: lines are handled as hashes, once for each different line.  A generalised template keeps one of the first three
stretches at least, so only lines that share such a stretch of their leaf with another line get the 15 template keys.

Defined results: blank lines never recur and stay; a null text stays null with zero lines; rows with a null doc_id stay
as they are and teach nothing; rows that share a doc_id are one document (repeated lines inside a document stay); text
is cut at "\n" only; an empty table gives no rows; other columns are kept (n_lines and n_dropped replace columns of
these names; other names may be anything).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import broadcast_if_small, checkpointed, joined_by_key

DEPTH, STATIC, TAIL, SEGMENTS = 3, 0.6, 4, 5
MIN_DOCS, LONG = 3, 30
WILD = "<*>"
#: The stretches that a generalised template keeps: all but one or two.
KEPT = [c for size in (SEGMENTS - 2, SEGMENTS - 1) for c in combinations(range(SEGMENTS), size)]


def masked(line: Column) -> Column:
    """A line's words, parted by one blank, the variable ones masked; '' for a blank line."""
    tidy = line.contains("\t") | line.contains("\r") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    words = F.when(tidy, F.trim(F.regexp_replace(line, r"[ \t\r]+", " "))).otherwise(line)
    wild = F.regexp_replace(words, r"[^ 0-9]*+[0-9][^ ]*+", WILD)
    variable = F.size(F.split(wild, r"<\*>")) - 1
    return F.when(words.rlike("[0-9]"), F.when(2 * variable > F.size(F.split(words, " ")), words).otherwise(wild)).otherwise(words)


def bound(j: int, n: Column) -> Column:
    """How many words behind the leading ones come before stretch j of a line of n words."""
    return F.ceil(j * (n - DEPTH) / SEGMENTS).cast("int")


def _pair(high: Column, low: Column) -> Column:
    """Two integers in one long."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, h, p0, p1, p2) of each line that is not blank.

    key tells texts of one id apart, h is the hash of the masked form; p holds, two to a long, the hashes of the line's
    leaf with one stretch each (zeros for lines too short to be generalised), and in the end the number of words.
    """
    line = docs.where("doc_id is not null").select(F.col("doc_id"), F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = line.select("doc_id", "key", "at", masked(F.col("line")).alias("line")).where("line <> ''").select("*", F.split("line", " ").alias("words"))
    n = F.size("words")
    stretch = [F.slice("words", bound(j, n) + (DEPTH + 1), bound(j + 1, n) - bound(j, n)) for j in range(SEGMENTS)]
    g = [F.when(n >= DEPTH + TAIL, F.hash(F.lit(j), n, F.slice("words", 1, DEPTH), s)).otherwise(0) for j, s in enumerate(stretch)]
    return checkpointed(line.select("doc_id", "key", "at", F.xxhash64("line").alias("h"), _pair(g[0], g[1]).alias("p0"), _pair(g[2], g[3]).alias("p1"), _pair(g[4], n).alias("p2")))


def unpacked(lines: DataFrame) -> DataFrame:
    """(h, docs, first_doc, n, g0 to g4)."""
    high, low = lambda p: F.shiftright(p, 32), lambda p: F.col(p).bitwiseAND(F.lit(0xFFFFFFFF))
    return lines.select("h", "docs", "first_doc", low("p2").cast("int").alias("n"), high("p0").alias("g0"), low("p0").alias("g1"), high("p1").alias("g2"), low("p1").alias("g3"), high("p2").alias("g4"))


def template_keys() -> Column:
    """The keys of a line's generalised templates, nulls where too few words would be kept."""
    n = F.col("n")
    keys = []
    for k, kept in enumerate(KEPT):
        words = sum((bound(j + 1, n) - bound(j, n) for j in kept), F.lit(0))
        keys.append(F.when(words >= STATIC * (n - DEPTH), F.xxhash64(F.lit(k), *(F.col(f"g{j}") for j in kept))))
    return F.array_compact(F.array(*keys))


def general_templates(by_line: DataFrame) -> DataFrame:
    """(h, n, docs, first_doc, template): the template keys of the lines that may share one with another line."""
    long = by_line.where(F.col("n") >= DEPTH + TAIL)
    # Two of five stretches are generalised at most, so one of the first three is kept.
    stretches = long.select("h", F.explode(F.array("g0", "g1", "g2")).alias("g"))
    shared = stretches.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    wanted = broadcast_if_small(joined_by_key(stretches, shared, "g").select("h").distinct())
    some = long.join(wanted, "h", "left_semi")
    return checkpointed(some.select("h", "n", "docs", "first_doc", F.explode(template_keys()).alias("template")))


def recurring(docs: DataFrame, hashed: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG) -> DataFrame:
    """(h, first_doc, n): masked lines with a recurring template, the first document of all these, and the line's documents."""
    packed = [F.first(p).alias(p) for p in ("p0", "p1", "p2")]
    slim = hashed.groupBy("h", "doc_id").agg(*packed)
    by_line = unpacked(checkpointed(slim.groupBy("h").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), *packed)))
    recurs = (F.col("docs") >= min_docs) | ((F.col("docs") >= 2) & (F.col("n") >= long))
    own = by_line.where(recurs).select("h", "first_doc", "docs")
    members = general_templates(by_line)
    found = members.groupBy("template").agg(F.count("*").alias("different"), F.sum("docs").alias("docs"), F.max("docs").alias("most"), F.min("first_doc").alias("first_doc"), F.first("n").alias("n"))
    # Templates of one line say what the line itself says.
    found = checkpointed(found.where("different > 1").where(recurs))
    sure = (F.col("most") >= min_docs) | ((F.col("most") >= 2) & (F.col("n") >= long))
    # Otherwise documents that hold several of a template's lines are counted once; each such line has few documents.
    unsure = members.select("h", "template").join(broadcast_if_small(found.where(~sure).select("template", "n")), "template")
    pairs = unsure.join(hashed.select("h", "doc_id"), "h").select("template", "n", "doc_id").distinct()
    counted = pairs.groupBy("template").agg(F.count("*").alias("docs"), F.first("n").alias("n")).where(recurs).select("template")
    first = found.select("template", "first_doc", F.col("different").alias("n"))
    good = first.join(found.where(sure).select("template").union(counted), "template", "left_semi")
    general = joined_by_key(members.select("h", "docs", "template"), good, "template").select("h", "first_doc", "docs")
    return own.union(general).groupBy("h").agg(F.min("first_doc").alias("first_doc"), F.max("docs").alias("n"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG) -> DataFrame:
    """The rows of docs with `text` cut, and the columns n_lines and n_dropped."""
    hashed = hashed_lines(docs)
    drop = recurring(docs, hashed, min_docs, long)
    lost = joined_by_key(hashed.select("doc_id", "key", "at", "h"), drop, "h").where("doc_id <> first_doc")
    by_doc = lost.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set("at").alias("_drop"))
    joined = docs.join(by_doc, (docs["doc_id"] == by_doc["_doc"]) & (F.xxhash64(docs["text"]) == by_doc["_key"]), "left")
    # The row's own columns travel in a struct, so their names meet no others.
    rows = joined.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.split(docs["text"], "\n").alias("lines"), by_doc["_drop"].alias("drop"))
    of = F.col("row").getField
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), of("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n"))
    size = F.when(of("text").isNull(), 0).otherwise(F.size("lines"))
    columns = [(text if c == "text" else of(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, size.alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_dropped"))
