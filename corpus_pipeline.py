"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

All stages keep rows with a null doc_id or text, an empty or very long text, and rows that repeat others, unless a stage says
otherwise; they keep further columns of any name, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nextbasket.llm import decontaminate, jaccard, lines, packing, toxicity
from nextbasket.llm.common import removed, saved, table, tracked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Texts that are null or empty get one score, that of an empty text; equal texts go or stay together."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, but for the first by doc_id (null last, ties by place); so do documents of which nothing else is left. Empty texts stay, a null text stays null."""
    return lines.dedup_runs(docs, drop_emptied=True).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest doc_id. Texts without words link with nothing; rows that repeat the smallest doc_id, or have none, stay."""
    return jaccard.one_of_each(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its own text. Null and empty texts hold none."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its bucket, batch and slot. Null and empty texts have one token, their end; equal lengths are placed by a fixed order; other columns are dropped."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("packing", pack),
]
#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on the way goes when its result is written, or when it fails, and a stage's result once the next has read it; other runs keep theirs."""
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with tracked() as paths:
            done = False
            try:
                docs = saved(stage(spark, docs, sf_dir))
                done = True
            finally:
                removed(spark, (paths[:-1] if done else paths) + last)
        last = paths[-1:]
    return docs
