"""Checks of tables and results; each returns the rows that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_spans(df: DataFrame, at: str, spans: str, strand: str = "strand", strands: str = "strands", flag: str = "sense") -> DataFrame:
    """Rows whose coordinate isn't in all their spans, or whose strand isn't listed though they are flagged."""
    inside = F.forall(spans, lambda s: (F.col(at) >= s["start"]) & (F.col(at) <= s["end"]))
    return df.where(~inside | (F.col(flag) & ~F.array_contains(strands, F.col(strand))))


def check_lists(df: DataFrame, text: str) -> DataFrame:
    """Rows with an empty token in a comma list: leading, doubled or trailing."""
    return df.where(F.col(text).rlike("^,|,,|,$"))


def reconcile_ids(used: DataFrame, known: DataFrame, key: str = "sid") -> DataFrame:
    """Keys that one side has alone, and which."""
    a, b = used.select(key).distinct(), known.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("used")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("known")))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The multiset difference both ways, with its side."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def split_groups(df: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Keys that end one part and begin another."""
    ends = df.groupBy(part).agg(F.min_by(key, order).alias("first"), F.max_by(key, order).alias("last"))
    firsts, lasts = ends.select(F.col("first").alias(key), F.col(part).alias("p")), ends.select(F.col("last").alias(key), F.col(part).alias("q"))
    return firsts.join(lasts, key).where("p <> q").select(key).distinct()


def reconcile_sums(exons: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """Keys whose sum differs from the coverage's, which counts as 0 where it is missing. Both: key, value."""
    out = exons.select(key, F.col("value").alias("expected")).join(bases.select(key, F.col("value").alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.where(F.col("expected") != F.col("found"))


def check_transcripts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys before and after, and sentinels (-1) left."""
    return before.agg(F.countDistinct(key).alias("n_before")).join(after.agg(F.countDistinct(key).alias("n_after"), F.count_if(F.col(key) == -1).alias("n_sentinel")))


def unmatched(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key).distinct(), key, "left_anti")


def check_counts(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Datasets whose row count isn't the expected one (key, expected)."""
    found = expected.join(df.groupBy(key).agg(F.count("*").alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return found.where("found <> expected")


def fraction_split(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each ratio column, how many values are at least a half and how many less."""
    values = df.unpivot([], columns, "ratio", "value")
    return values.groupBy("ratio").agg(F.count_if(F.col("value") >= 0.5).alias("n_high"), F.count_if(F.col("value") < 0.5).alias("n_low"))
