"""From raw documents to packed sequences: each stage's result is written as Parquet and read as the next one's documents.

All stages judge rows one by one, whatever their doc_id (null or repeated), keep all columns of documents, and give no rows of an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import decontam, langid, pow2pack, simhash, toxzstd
from spanlake.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; learned from the labels of the documents given. Without labels nothing is known to be toxic and all stay."""
    return toxzstd.keep_clean(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without null texts, texts without letters, and texts of none of the learned languages."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id, null ones last; of ties the least text, of equal texts any one."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item; an empty benchmark takes none."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; an empty text gives its end alone."""
    return pow2pack.report(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the dictionaries, trees, fingerprints and tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; all but the last one's results lie in the shared folder until that is cleared."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
