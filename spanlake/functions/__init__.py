"""Column functions: the sparse sample list, its statistics, and small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_samples(text: Column | str) -> Column:
    """`,sid:cov,sid:cov` as an array of structs; empty tokens are passed over, null gives an empty array."""
    tokens = F.filter(F.split(F.coalesce(col(text), F.lit("")), ","), lambda t: t != "")
    return F.transform(tokens, lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).cast("long").alias("sid"), F.split_part(t, F.lit(":"), F.lit(2)).cast("long").alias("cov")))


def encode_samples(samples: Column | str) -> Column:
    """The reverse of decode_samples, with the leading comma."""
    return F.concat_ws("", F.transform(col(samples), lambda s: F.concat(F.lit(","), s["sid"].cast("string"), F.lit(":"), s["cov"].cast("string"))))


def decode_sources(text: Column | str) -> Column:
    """A comma list of source codes, `0` or empty for none, as a sorted array of distinct codes."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(col(text), F.lit("0")), ","), lambda t: (t != "0") & (t != ""))))


def encode_sources(sources: Column | str) -> Column:
    s = col(sources)
    return F.when(F.size(s) > 0, F.array_join(s, ",")).otherwise("0")


def coverages(samples: Column | str) -> Column:
    return F.transform(col(samples), lambda s: s["cov"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def median(values: Column) -> Column:
    """The middle of an array, or the mean of the two middle ones; 0 of an empty array."""
    s, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / F.lit(2.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(middle)


def summary(samples: Column | str) -> dict[str, Column]:
    """The four statistics of a sample list; zeros where it is empty or null. Entries with a null coverage don't count."""
    c = F.coalesce(F.filter(coverages(samples), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))
    n = F.size(c)
    return {
        "samples_count": n.cast("long"),
        "coverage_sum": total(c),
        "coverage_avg": F.when(n == 0, F.lit(0.0)).otherwise(total(c) / F.when(n == 0, 1).otherwise(n)),
        "coverage_median": median(c),
    }


def keep_samples(samples: Column | str, sids: list[int]) -> Column:
    """The entries of the given samples, in stored order."""
    return F.filter(col(samples), lambda s: s["sid"].isin([int(x) for x in sids]))


def gene_descriptor(gene_id, gene_name, gene_type, bp_length) -> Column:
    """id:name:type:length, as genes and exons carry it in place of sources."""
    return F.concat_ws(":", *(col(c).cast("string") for c in (gene_id, gene_name, gene_type, bp_length)))


def descriptor_part(text: Column | str, which: int) -> Column:
    return F.split_part(col(text), F.lit(":"), F.lit(which))


def normalise_strand(strand: Column | str) -> Column:
    return F.when(col(strand) == "?", "*").otherwise(col(strand))


def add_chr(chrom: Column | str) -> Column:
    c = col(chrom)
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def strip_chr(chrom: Column | str) -> Column:
    return F.regexp_replace(col(chrom), "^chr", "")


def row_key(kind: str) -> Column:
    """How an expression row is named: by gene id, or by place."""
    return F.col("gene_id").cast("string") if kind == "gene" else F.concat_ws("", "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
