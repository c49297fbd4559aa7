"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's docs.

Null, empty and blank texts have no words and go in the first stage.  Rows
without a doc_id are kept like others, but link with nothing in jaccard_join.
Rows equal in id and text are one document: what one of them loses all lose,
and all of them stay.  Of texts that tie, the one with the smallest doc_id
stays.  Other columns pass through whatever their names.  An empty table gives
empty tables.  Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.llm import jaccard, lines, packing, quality, suffix
from boscage.llm.store import Scratch
from boscage.llm.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust outlier rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go; documents left blank go."""
    return lines.remove_lines(docs, least_exact=1, rule=lines.BY_LENGTH)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    found = jaccard.jaccard_groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__other_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["__other_id"], "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    return suffix.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, each with its ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: No stage but the first can be written as SQL that runs on whole tables; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = len(Scratch.opened)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        for own in Scratch.opened[before:]:  # the written table needs nothing of them
            own.remove()
        del Scratch.opened[before:]
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
