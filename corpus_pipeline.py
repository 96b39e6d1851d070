"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents;
the last one returns the pieces of the packed sequences.

Defined results: stages decide for each row by its own text, so rows without an id and rows of one id are told apart; a
null or empty text is neither toxic nor contaminated, all such texts are one group of copies, and what is left of it is
packed as the single id 0; an empty table gives no rows; columns beside those of documents are kept until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import decontaminate, linededup, neardup, packing, toxicity
from pagelens.llm.common import checkpoint_folder, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has a toxicity score of 0.5 or more go."""
    return toxicity.clean_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all but the first document that has them; documents that this leaves without text go."""
    # A caller's own columns of the names that the counts have stand aside meanwhile.
    aside = {c: f"{c} of the caller" for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    cut = linededup.dedup_lines(docs.withColumnsRenamed(aside))
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")) == "")
    kept = cut.where(~emptied).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in aside.items()})
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row stays, that with the smallest id."""
    return neardup.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text overlaps an item of benchmark go; an empty benchmark takes nothing."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; every row is packed, repeated ones as often as they occur."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]
#: Not expressible in SQL (trained scores, byte-BPE ids); tests/llm holds it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet in the shared folder and read again.

    A stage's input goes once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
