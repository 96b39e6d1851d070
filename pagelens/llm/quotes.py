r"""Quotation linking for chat and mail: DataFrame functions only.

A line's quote level is the number of `>` it starts with.  A passage is a run of lines of one level without blank
lines between them; it is normalised (lower case, white space collapsed, so re-wrapped text stays equal) and hashed,
and so is each of its lines.  A quoted passage is joined to the first message of its conversation that holds the same
passage or line unquoted.  A message replies to the earlier message that most of its words at the lowest linked level
are quoted from (ties: the later one).  Following replies up to a message without one gives the thread; pointers are
doubled round by round, so a chain of n replies takes about log2(n) rounds.

Result: one row for each message: conv_id, thread_turn (turn of the thread's first message), depth, turn, role,
parent_turn, n_quoted (passages), n_linked (how many of these have a link), text without quotes, and chat (a turn of the template
`<|role|>`).  The rows are sorted by conv_id, thread_turn and turn, so a reply follows the message that it answers.

Defined results: exact repetitions of a message are one; several messages with one turn are kept, ordered by role and
text; without a quote that links, a message is a thread of its own; a null text is empty; null ids, turns and roles keep
their rows, but null ids and turns link nothing; a quote of later messages or of none links nothing; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import checkpointed

MARK = r"^(?:[ \t]*>)+"
#: Fixed value: a line that introduces a quotation.
ATTRIBUTION = r"(?i)^on .{1,200} wrote:\s*$"
MAX_ROUNDS = 40


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """The lines that are not quoted; where there are any quotes, lines that introduce them go too."""
    lines = F.split(text, "\n")
    plain = F.filter(lines, lambda x: ~x.rlike(MARK) & ~x.rlike(ATTRIBUTION))
    return F.when(text.rlike(r"(?m)" + MARK), F.trim(F.array_join(plain, "\n"), F.lit(" \n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, at, unit, words): passages (unit `p`) and their lines (unit `l`), normalised and hashed.

    `messages` has mid, a key of the message.  The window is over the lines of one message.
    """
    line = messages.select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = line.select("mid", "conv_id", "turn", "at", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("body"))
    order = Window.partitionBy("mid").orderBy("at")
    begins = F.coalesce((F.lag("level").over(order) != F.col("level")) | (F.lag("body").over(order) == ""), F.lit(True))
    line = line.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order)).where("body <> ''")
    whole = line.groupBy("mid", "conv_id", "turn", "level", "run").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["body"]), " ")
    units = F.concat(F.array(F.struct(F.lit("p").alias("unit"), body.alias("body"))), F.when(F.size("lines") > 1, F.transform("lines", lambda x: F.struct(F.lit("l").alias("unit"), x["body"].alias("body")))).otherwise(F.array().cast("array<struct<unit:string,body:string>>")))
    return whole.select("mid", "conv_id", "turn", "level", "at", F.explode(units).alias("u")).select("mid", "conv_id", "turn", "level", "at", "u.unit", F.xxhash64("u.body").alias("h"), F.size(F.split("u.body", " ")).alias("words"))


def reply_links(found: DataFrame) -> DataFrame:
    """(mid, parent, parent_turn, n_linked): the message that each message with a linked quote replies to."""
    known = found.where("conv_id is not null and turn is not null")
    originals = known.where("level = 0").groupBy("conv_id", "h").agg(F.min(F.struct("turn", "mid")).alias("first"))
    linked = known.where("level > 0").join(originals, ["conv_id", "h"]).where("first.turn < turn")
    linked = checkpointed(linked.select("mid", "level", "first", "words", "at"))
    votes = linked.groupBy("mid", "level", "first").agg(F.sum("words").alias("words"))
    best = votes.groupBy("mid").agg(F.min(F.struct("level", -F.col("words"), -F.col("first.turn"), "first.mid", "first.turn")).alias("b"))
    # A passage counts once, from however many messages its lines are.
    passages = linked.groupBy("mid").agg(F.count_distinct("at").alias("n_linked"))
    return best.join(passages, "mid").select("mid", F.col("b.mid").alias("parent"), F.col("b.turn").alias("parent_turn"), "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """(mid, root, root_turn, depth) for each message with a parent, by pointer doubling."""
    up = checkpointed(links.select("mid", F.col("parent").alias("root"), F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    for _ in range(MAX_ROUNDS):
        above = up.select(F.col("mid").alias("root"), F.col("root").alias("r2"), F.col("root_turn").alias("t2"), F.col("depth").alias("d2"))
        stepped = up.join(above, "root", "left")
        if stepped.where("r2 is not null").isEmpty():
            return up
        up = checkpointed(stepped.select("mid", F.coalesce("r2", "root").alias("root"), F.coalesce("t2", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
    raise RuntimeError("reply chains did not settle")


def link_quotations(messages: DataFrame) -> DataFrame:
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    messages = messages.select(*columns).distinct().withColumn("mid", F.sha1(F.to_json(F.struct("conv_id", "turn", "role", "text"))))
    # Only conversations with a quote have anything to link.
    quotes = messages.where(F.col("text").rlike(r"(?m)" + MARK))
    # Quotes outside of a conversation link nothing, but are counted.
    quoting = messages.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").unionByName(quotes.where("conv_id is null"))
    found = checkpointed(passages(quoting))
    links = checkpointed(reply_links(found))
    roots = thread_roots(links)
    quoted = found.where("level > 0 and unit = 'p'").groupBy("mid").agg(F.count("*").alias("n_quoted"))
    rows = messages.join(links, "mid", "left").join(roots, "mid", "left").join(quoted, "mid", "left")
    text = without_quotes(F.col("text"))
    rows = rows.select("conv_id", F.coalesce("root_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "turn", "role", "parent_turn", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), text.alias("text"))
    rows = rows.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n")))
    return rows.orderBy("conv_id", "thread_turn", "turn", "role", "text")
