"""Schemas of the tables: features, sample metadata, sample groups, base coverage."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.ArrayType(T.StructType([T.StructField("sid", T.LongType()), T.StructField("cov", T.LongType())]))

#: The seventeen columns of a feature as text, in file order.
FEATURE_TEXT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("feature_id",)]
    + [T.StructField("chrom", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "end", "length")]
    + [T.StructField(n, T.StringType()) for n in ("strand", "annotated", "left_motif", "right_motif", "left_sources", "right_sources", "samples")]
    + [T.StructField(n, T.LongType()) for n in ("samples_count", "coverage_sum")]
    + [T.StructField(n, T.DoubleType()) for n in ("coverage_avg", "coverage_median")]
    + [T.StructField("source_id", T.IntegerType())]
)
FEATURE_COLUMNS = [f.name for f in FEATURE_TEXT]

#: Chromosomes that count as standard: autosomes of one or two digits, X, Y and M.
STANDARD_CHROM = r"^chr([0-9]{1,2}|X|Y|M)$"
