"""A training corpus from raw documents: language filter, near-dedup, substring dedup, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result as a Parquet table in the
shared folder and hands the table that was read back to the next stage. All stages but the last return the columns of
documents. SQL cannot express the n-gram filters and the packing, so there is no counterpart in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfdate.llm.common import keep, table
from shelfdate.llm.language import in_known_language
from shelfdate.llm.minhash import one_of_each
from shelfdate.llm.mixing import mixed
from shelfdate.llm.packing import pack
from shelfdate.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard 0.8 or more), the one with the smallest id; with
    30 bands of 5 rows a pair at 0.8 is missed with a probability of 7e-6."""
    return one_of_each(docs, percent=80, bands=30)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that a document with a smaller id has too."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them: left out, once, or repeated."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs).select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
