"""From raw documents to packed ones: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read again as the docs of
the next one. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import exact, langid, neardup, packing, quality
from factorloom.llm.common import prepare, table
from factorloom.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no known language: texts without a letter, and texts far from all that was learned."""
    prepare(spark)
    return langid.keep_known(docs, "doc_id", "text", "lang")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or a rule with a guaranteed cutoff rejects; cutoffs come from the labels of docs."""
    prepare(spark)
    return quality.filter_quality(docs, "doc_id", "text", "lang", table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of each text."""
    prepare(spark)
    return exact.drop_copies(docs, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    prepare(spark)
    return neardup.drop_near_copies(docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and start of every piece of every document."""
    prepare(spark)
    return packing.pack_documents(docs, "doc_id", "text", "source")


STAGES = [("language id", language), ("quality rules", rules), ("exact dedup", copies), ("near dedup", near_copies), ("packing", pack)]

#: Python decides in the first stages, so SQL cannot say the whole; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
