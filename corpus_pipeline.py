"""Documents to packed training sequences: language ID, toxicity, exact dedup, near-dedup, best-fit packing.

Each stage gets what the one before it kept, written as Parquet and read again, and all but the last return the columns
of documents. The staged tables lie in the shared folder until tabsieve.scratch.clean_up deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import exact_dedup, langid, packing, simhash, toxicity
from tabsieve.llm.common import new_path, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words have no certain language, go."""
    return langid.keep_identified(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after normalising spaces, the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints differ in 8 bits at most and whose 5-word shingles have a similarity of 0.8
    or more, one document stays: the one with the smallest doc_id, null ids last."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their bins. The stages before leave one text of each cluster of packing's
    own measure, so that here only sources conflict."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Learned models and best-fit packing are beyond SQL. Tests hold the deduplicating and packing stages against brute
#: force, the learned ones against held-out rows, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs
