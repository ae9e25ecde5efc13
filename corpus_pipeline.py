"""The corpus pipeline: rejected documents go, repeated lines are cut, one document of each
near-duplicate group stays, sources are mixed to their targets, and what is left becomes tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinpeak.llm import jaccard_join, line_dedup, mixing, quality_rules, sentencepieces
from twinpeak.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (7)."""
    return quality_rules.keep_good(docs, quality_rules.good_ids(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs cut (8), n_chars as the text is now; documents that lose every line go."""
    return line_dedup.keep_first_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join (4), by five words and 0.8."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them (2)."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each row of the mix (1)."""
    return sentencepieces.encode(docs).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mixing", mixture),
    ("sentencepiece", tokens),
]

#: Set hashes, connected components and Viterbi paths have no SQL counterpart here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
