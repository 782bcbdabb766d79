"""Studies of flanking junctions, repeats, tissues, and two-group comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions import median, total
from spanlake.operators.intervals import BIN, any_covers, bases_of, level_of, merged, overlap_join, stab_join
from spanlake.operators.stats import long_stats
from spanlake.scratch import stored


#: Samples, with a name each, up to which a table of them is broadcast.
BROADCAST = 500_000
#: Junctions that come along with a place; those beyond form a place of their own.
KEYS = 10_000


def ends(df: DataFrame, key: str = "feature_id") -> DataFrame:
    """Both ends of each junction as points: side, at."""
    return df.select(key, "chrom", F.posexplode(F.array("start", "end")).alias("side", "at"))


def _ends_of_gene(df: DataFrame, genes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Distinct (keys, gene) where both ends, of any rows of the keys, lie in the gene, on whichever of its intervals."""
    points = df.select(*keys, "chrom", F.posexplode(F.array("start", "end")).alias("side", "at"))
    hits = stab_join(points.distinct(), genes.select("b_chrom", "b_start", "b_end", "gene"), "at", width).select(*keys, "side", "gene").distinct()
    return hits.groupBy(*keys, "gene").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def _by_count(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key comes once, and the others."""
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")


def same_gene(df: DataFrame, genes: DataFrame, key: str = "feature_id", width: int = BIN, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Junctions with both ends in one gene (b_chrom, b_start, b_end, gene), and the sorted genes. form: what becomes of a list, worked out once for a place.

    Lists of genes are made once for each distinct place, where they meet: a place lies in one bin, that of its level which has its start, with all intervals that may
    hold it, and takes its junctions along, KEYS at most; so neither lists nor pairs are shuffled. Genes of one interval, gathered by place, hold both ends or not; only
    genes of several intervals, and junctions at several places, are looked up end by end. The former come back to the bins as intervals that hold just that place.
    """
    places, bins = ["chrom", "start", "end"], ["chrom", "_level", "_bin"]
    once, often = _by_count(df.select(key, *places).distinct(), key)
    one, several = _by_count(genes.select("b_chrom", "b_start", "b_end", "gene").distinct(), "gene")
    level = lambda start, end: level_of(F.col(end) - F.col(start) + 1, width)
    bin_of = lambda at, level: F.floor(F.col(at) / bases_of(F.col(level), width))
    own = once.where("chrom is not null and start is not null and end is not null").select(key, "chrom", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    own = own.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(*places).orderBy(key)) - 1) / KEYS)).groupBy(*places, "_part").agg(F.collect_list(F.struct(F.col(key).alias("key"))).alias("_keys"))
    own = stored(own.withColumn("_level", level("start", "end")).withColumn("_bin", bin_of("start", "_level")))
    held = one.where("b_start <= b_end").groupBy("b_chrom", "b_start", "b_end").agg(F.collect_list("gene").alias("_genes"))
    held = held.withColumn("_b_level", F.explode(F.sequence(F.lit(0), level("b_start", "b_end"))))  # nothing longer than itself lies in it
    held = held.withColumn("_b_bin", F.explode(F.sequence(bin_of("b_start", "_b_level"), bin_of("b_end", "_b_level")))).withColumn("_just", F.lit(False))
    parts = _ends_of_gene(own.select(*places).distinct().withColumns({"_c": F.col("chrom"), "_s": F.col("start"), "_e": F.col("end")}), several, ["_c", "_s", "_e"], width)
    parts = parts.groupBy(F.col("_c").alias("b_chrom"), F.col("_s").alias("b_start"), F.col("_e").alias("b_end")).agg(F.collect_list("gene").alias("_genes"))
    parts = parts.withColumn("_b_level", level("b_start", "b_end")).withColumn("_b_bin", bin_of("b_start", "_b_level")).withColumn("_just", F.lit(True))
    alone = own.select(*bins).distinct().select(F.col("chrom").alias("b_chrom"), F.col("_level").alias("_b_level"), F.col("_bin").alias("_b_bin"))  # with this the junctions come, once
    right = held.unionByName(parts).unionByName(alone, allowMissingColumns=True)
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_level") == F.col("_b_level")) & (F.col("_bin") == F.col("_b_bin"))
    fits = (F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end")) & (~F.col("_just") | ((F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))))
    pairs = own.join(right.hint("merge"), on & (F.col("_genes").isNull() | fits)).withColumn("_keys", F.when(F.col("_genes").isNull(), F.col("_keys")))
    lists = pairs.groupBy(*bins, "start", "end", "_part").agg(F.collect_list("_genes").alias("_lists"), F.first("_keys", ignorenulls=True).alias("_keys")).where(F.size("_lists") > 0)
    form = form or (lambda x: x)
    found = lists.withColumn("genes", form(F.sort_array(F.flatten("_lists")))).select(F.explode("_keys").alias("_k"), "genes").select(F.col("_k.key").alias(key), "genes")
    rest = _ends_of_gene(often, genes, [key], width).groupBy(key).agg(F.array_sort(F.collect_list("gene")).alias("genes")).withColumn("genes", form(F.col("genes")))
    return found.unionByName(rest)


def in_same_gene(df: DataFrame, genes: DataFrame, key: str = "feature_id", width: int = BIN, strand: str | None = None) -> DataFrame:
    """Keys of junctions with both ends in one gene, each once; no list is made. strand: a column of both; then keys and the strands, of those that the junction
    has, that such a gene has (of junctions at several places: all strands that such a gene has)."""
    also = [strand] if strand else []
    once, often = _by_count(df.select(key, "chrom", "start", "end", *also).distinct(), key)
    one, several = _by_count(genes.select("b_chrom", "b_start", "b_end", "gene", *also).where("gene is not null" if strand else "true").distinct(), "gene")
    at = once.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})
    whole = any_covers(at, one.withColumnsRenamed({c: f"b_{c}" for c in also}), {"_in": ("start", "end")}, ("chrom", *also)).where("_in").select(key, *also)
    strands = several.select("gene", *also).unionByName(one.select("gene", *also)).distinct()
    ends_in = _ends_of_gene(once, several, [key], width).unionByName(_ends_of_gene(often, genes, [key], width))
    parts = ends_in.join(strands.hint("merge"), "gene").select(key, *also) if strand else ends_in.select(key)
    return whole.unionByName(parts).distinct()


def end_flags(df: DataFrame, exons: DataFrame, key: str = "feature_id", width: int = BIN) -> DataFrame:
    """For each junction, whether its start and its end lie in an exon."""
    return any_covers(df, exons, {"start_in": ("start", "start"), "end_in": ("end", "end")})


def one_end_in_exon(df: DataFrame, exons: DataFrame, key: str = "feature_id", width: int = BIN) -> DataFrame:
    return end_flags(df, exons, key, width).where(F.col("start_in") != F.col("end_in"))


def end_in_repeat(flagged: DataFrame, repeats: DataFrame, key: str = "feature_id", width: int = BIN) -> DataFrame:
    """Pairs of a junction with one end in an exon and a repeat (b_*, repeat columns) that holds the other end."""
    other = flagged.withColumn("at", F.when(F.col("end_in"), F.col("start")).otherwise(F.col("end")))
    return stab_join(other, repeats, "at", width)


def sense_flags(pairs: DataFrame, strands: dict[str, str], key: str = "feature_id") -> DataFrame:
    """For each junction, whether any of its partners of each kind (name: strand column) has its strand, and whether all kinds do."""
    agreed = {name: F.bool_or(F.coalesce(F.col(strand) == F.col("strand"), F.lit(False))) for name, strand in strands.items()}
    out = pairs.groupBy(key).agg(*(v.alias(k) for k, v in agreed.items()))
    every = F.lit(True)
    for name in strands:
        every = every & F.col(name)
    return out.withColumn("both_sense", every)


def repeat_study(df: DataFrame, genes: DataFrame, exons: DataFrame, repeats: DataFrame, key: str = "feature_id", width: int = BIN) -> DataFrame:
    """Junctions (key, chrom, start, end, strand) with both ends in one gene, one of them in an exon and the other in a repeat: key, gene_sense (some exon that is
    hit has the junction's strand), repeat_sense (some repeat has), both_sense. genes: b_*, gene; exons and repeats: b_*, strand as exon_strand and
    repeat_strand. An unknown strand agrees with none; equal rows of a key count as one junction.
    """
    own = df.select(key, "chrom", "start", "end", "strand")
    both = one_end_in_exon(own, exons, key, width).join(in_same_gene(own, genes, key, width).hint("merge"), key, "left_semi")
    flagged = stored(both.withColumns({"here": F.when(F.col("end_in"), F.col("end")).otherwise(F.col("start")), "there": F.when(F.col("end_in"), F.col("start")).otherwise(F.col("end"))}))
    hit = any_covers(flagged, repeats, {"_hit": ("there", "there")}).where("_hit")
    sense = any_covers(hit, exons.withColumnRenamed("exon_strand", "b_strand"), {"gene_sense": ("here", "here")}, ("chrom", "strand"), points=flagged)
    sense = any_covers(sense, repeats.withColumnRenamed("repeat_strand", "b_strand"), {"repeat_sense": ("there", "there")}, ("chrom", "strand"), points=flagged)
    out = sense.groupBy(key).agg(F.bool_or("gene_sense").alias("gene_sense"), F.bool_or("repeat_sense").alias("repeat_sense"))
    return out.withColumn("both_sense", F.col("gene_sense") & F.col("repeat_sense"))


def rel_by_sample(entries: DataFrame, flags: DataFrame, key: str = "feature_id", counted: Column | None = None) -> DataFrame:
    """For each sample: flagged features, those of both, gene and repeat sense, and coverage. No flag is broadcast: they grow with the features.

    flags: a row for each flagged feature. counted: which entries, flagged or not, make up a sample's totals; n_total and coverage_total are then had from the same
    pass over the entries, and a sample without a flagged feature has nulls for its counts."""
    both = entries.join(flags.withColumn("_hit", F.lit(True)).hint("merge"), key, "inner" if counted is None else "left")
    found = {"n": F.count("_hit"), "n_both": F.count_if("both_sense"), "n_gene": F.count_if("gene_sense"), "n_repeat": F.count_if("repeat_sense"), "coverage": F.sum(F.when(F.col("_hit"), F.col("cov")))}
    if counted is not None:
        some = F.count("_hit") > 0
        found = {k: F.when(some, v) for k, v in found.items()} | {"n_total": F.count_if(counted), "coverage_total": F.coalesce(F.sum(F.when(counted, F.col("cov"))), F.lit(0))}
    return both.groupBy("sid").agg(*(v.alias(k) for k, v in found.items()))


def rel_fractions(counts: DataFrame, totals: DataFrame, members: DataFrame) -> DataFrame:
    """Those counts over the samples' totals (sid, and n_total and coverage_total unless the counts have them); null where a total is 0. member: whether the sample is in `members`."""
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = totals.join(counts, "sid", "left").join(members.select("sid", F.lit(True).alias("member")).distinct(), "sid", "left")
    return out.select("sid", part("n", "n_total").alias("n_fraction"), part("coverage", "coverage_total").alias("coverage_fraction"), F.coalesce("member", F.lit(False)).alias("member"))


def label_overlaps(df: DataFrame, sets: dict[str, DataFrame], key: str = "feature_id", width: int = BIN) -> DataFrame:
    """For each feature and named set of intervals (b_*, label), the distinct labels of what it overlaps, sorted and joined.

    Intervals of a label are merged before the join, so that a place meets a label's stretches of bases, not all of its intervals."""
    tagged = None
    for name, s in sets.items():
        one = s.select("b_chrom", "b_start", "b_end", F.col("label").cast("string").alias("label"), F.lit(name).alias("set"))
        tagged = one if tagged is None else tagged.unionByName(one)
    places = ["chrom", "start", "end"]
    pairs = overlap_join(df.select(*places).distinct(), merged(tagged.where("label is not null"), ["set", "label"]), width)
    columns = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("set") == n, F.col("label")))), ";").alias(n) for n in sets]
    found = pairs.groupBy(*places).agg(*columns)
    return df.select(key, *places).join(found.hint("merge"), places, "left").select(key, *(F.coalesce(n, F.lit("")).alias(n) for n in sets))


def intron_repeat_pairs(introns: DataFrame, tx: DataFrame, exons: DataFrame, repeats: DataFrame, key: str = "feature_id", width: int = BIN) -> DataFrame:
    """Introns inside a transcript, not inside one exon, with one end at most in an exon, and a repeat that holds an end outside exons."""
    inside = any_covers(introns.where("start <= end"), tx, {"_inside": ("start", "end")}).where("_inside").drop("_inside")
    tests = {"_swallowed": ("start", "end"), "start_in": ("start", "start"), "end_in": ("end", "end")}
    flagged = any_covers(inside, exons, tests).where("not _swallowed and not (start_in and end_in)")
    points = flagged.select(key, "chrom", "strand", F.explode(F.array(F.struct(F.col("start").alias("at"), F.col("start_in").alias("taken")), F.struct(F.col("end").alias("at"), F.col("end_in").alias("taken")))).alias("p")).where("not p.taken").select(key, "chrom", "strand", "p.at")
    return stab_join(points, repeats, "at", width).drop("b_chrom", "b_start", "b_end")


def dedup_rel_counts(pairs: DataFrame, entries: DataFrame, sense: Column, key: str = "feature_id") -> DataFrame:
    """For each sample, features in any pair and those with a pair of the same sense, each feature once."""
    once = pairs.groupBy(key).agg(F.bool_or(sense).alias("sense"))
    return entries.join(once, key).groupBy("sid").agg(F.count("*").alias("n"), F.count_if("sense").alias("n_sense"))


def lookup_pairs(pairs: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (from_chrom, from_start, from_end, to_...) with columns of the features at exactly these places, null where there is none."""
    out = pairs
    for side in ("from", "to"):
        place = df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("chrom", "start", "end", *columns)))
        out = out.join(place, [f"{side}_{c}" for c in ("chrom", "start", "end")], "left")
    return out


def derive_layout(md: DataFrame, text: str) -> DataFrame:
    """First number in a text column, how many numbers it has, and the layout that follows: paired from two on."""
    numbers = F.regexp_extract_all(F.col(text), F.lit("([0-9]+)"), F.lit(1))
    return md.withColumn("first_number", F.try_element_at(numbers, F.lit(1)).cast("long")).withColumn("n_numbers", F.size(numbers).cast("long")).withColumn("layout", F.when(F.col("n_numbers") >= 2, "paired").when(F.col("n_numbers") == 1, "single").otherwise("unknown"))


def shared_samples(pairs: DataFrame) -> DataFrame:
    """For pairs with arrays left and right (sid, cov; null counts as empty): the shared samples, their number and share of either side, sums over either side and both,
    mean and median over the shared samples of what both sides have together, and the samples of one side only. An empty side has share 0, no shared sample mean and median -1."""
    sides = {s: F.coalesce(F.col(s), F.array().cast("array<struct<sid:bigint,cov:bigint>>")) for s in ("left", "right")}
    sids = lambda side: F.transform(side, lambda s: s["sid"])
    # entries of both sides in order of samples: of a shared sample they follow one another
    marked = lambda side: F.transform(side, lambda x: F.struct(x["sid"].alias("sid"), F.lit(side).alias("side"), x["cov"].alias("cov")))
    out = pairs.withColumns(sides).withColumn("_s", F.array_sort(F.concat(marked("left"), marked("right"))))
    after = lambda i: F.get("_s", i + 1)
    met = F.transform("_s", lambda x, i: F.struct(x["sid"].alias("sid"), x["cov"].alias("l"), after(i)["cov"].alias("r"), F.coalesce(after(i)["sid"] == x["sid"], F.lit(False)).alias("both")))
    out = out.withColumn("_b", F.filter(met, lambda x: x["both"])).withColumns({"shared": F.col("_b.sid"), "_l": F.col("_b.l"), "_r": F.col("_b.r")})
    out = out.withColumn("_c", F.zip_with("_l", "_r", lambda x, y: x + y))
    n = F.size("shared").cast("long")
    share = lambda side: F.coalesce(n / F.nullif(F.size(side), F.lit(0)), F.lit(0.0))
    none = lambda value: F.when(n == 0, F.lit(-1.0)).otherwise(value)
    out = out.withColumns({"n_shared": n, "left_ratio": share("left"), "right_ratio": share("right"), "shared_sum": total(F.col("_c")), "left_sum": total(F.col("_l")), "right_sum": total(F.col("_r")), "shared_avg": none(total(F.col("_c")) / F.when(n == 0, 1).otherwise(n)), "shared_median": none(median(F.col("_c")))})
    return out.withColumns({"left_only": F.array_sort(F.array_except(sids("left"), sids("right"))), "right_only": F.array_sort(F.array_except(sids("right"), sids("left")))}).drop("_c", "_l", "_r", "_s", "_b")


def all_shared(left: DataFrame, right: DataFrame, key: str = "gene") -> DataFrame:
    """Both flanks' junctions (key, sid, cov) summed by sample, and over shared samples the sums of products and of minima, and the products' mean and median."""
    side = lambda df, name: df.groupBy(key, "sid").agg(F.sum("cov").alias(name))
    both = side(left, "l").join(side(right, "r"), [key, "sid"])
    product = F.col("l") * F.col("r")
    return both.groupBy(key).agg(F.count("*").alias("n_shared"), F.sum(product).alias("products"), F.sum(F.least("l", "r")).alias("minima"), F.avg(product).alias("mean"), F.median(product).alias("median"))


def flank_geometry(pairs: DataFrame) -> DataFrame:
    """Lengths of the two introns and of the exon between them, and whether both introns are annotated."""
    return pairs.withColumns({"left_intron": F.col("left_end") - F.col("left_start") + 1, "right_intron": F.col("right_end") - F.col("right_start") + 1, "exon": F.col("right_start") - F.col("left_end") - 1, "both_annotated": F.col("left_annotated") & F.col("right_annotated")})


def tissue_breakdown(entries: DataFrame, tissues: DataFrame, key: str = "feature_id") -> DataFrame:
    """Samples and coverage of each tissue in each list, its share of samples, and the rank by share, then name; with the list's number of tissues and largest share.

    Up to BROADCAST samples are brought to the entries, which so stay dealt out as they are, by lists or not; more are joined by a shuffle of both."""
    few = tissues.limit(BROADCAST + 1).count() <= BROADCAST
    sums = entries.join(F.broadcast(tissues) if few else tissues, "sid").groupBy(key, "tissue").agg(F.count("*").alias("n"), F.sum("cov").alias("coverage"))
    w = Window.partitionBy(key)
    out = sums.withColumn("ratio", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "tissue")))
    return out.withColumns({"n_tissues": F.count("*").over(w), "max_ratio": F.max("ratio").over(w)})


def avg_median(entries: DataFrame, keys: DataFrame, key: str, value: str, spread: bool = False) -> DataFrame:
    """Mean and median of each key's values, -1 where there are none. spread: as for `long_stats`."""
    found = long_stats(entries, key, value, spread).select(key, F.col("coverage_avg").alias("mean"), F.col("coverage_median").alias("median"))
    return keys.select(key).distinct().join(found, key, "left").select(key, F.coalesce("mean", F.lit(-1.0)).alias("mean"), F.coalesce("median", F.lit(-1.0)).alias("median"))


def inclusion_queries(pairs: DataFrame) -> DataFrame:
    """Query rows of an inclusion ratio for pairs that share a sample: both inclusion junctions in group B, the junction that skips the exon in group A."""
    row = lambda group, start, end: F.struct(F.lit(group).alias("group"), F.col(start).alias("start"), F.col(end).alias("end"))
    own = pairs.where(F.arrays_overlap(F.transform("left", lambda s: s["sid"]), F.transform("right", lambda s: s["sid"])))
    return own.select("pair", "chrom", F.explode(F.array(row("B", "left_start", "left_end"), row("B", "right_start", "right_end"), row("A", "left_start", "right_end"))).alias("q")).select("pair", "chrom", "q.*")


def mixed_strands(df: DataFrame, gene: str = "gene") -> DataFrame:
    """Genes whose rows have more than one strand."""
    return df.groupBy(gene).agg(F.countDistinct("strand").alias("n_strands")).where("n_strands > 1")


def compare_ranked(df: DataFrame, a: str = "a", b: str = "b", top: int = 5, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Two ranked lists of names, `?` dropped. Over the first x places, x the shortest of `top` and both lists: the share of places that agree, and of names of a's that b's has, too;
    the share of all of a's names that b has; whether the first names are the same; and whether one list's first is the other's second. Without a name there is no share: 0."""
    names = lambda c: F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "?"), lambda x: F.coalesce(F.create_map(*(F.lit(v) for p in synonyms.items() for v in p))[x], x) if synonyms else x)
    out = df.withColumns({"_a": names(a), "_b": names(b)})
    out = out.withColumn("_x", F.least(F.lit(top), F.size("_a"), F.size("_b")))
    first = lambda c: F.slice(c, F.lit(1), F.col("_x"))
    agreed = F.size(F.filter(F.zip_with(first("_a"), first("_b"), lambda x, y: x == y), lambda x: x))
    common = lambda x, y: F.size(F.array_intersect(x, y))
    share = lambda x, of: F.coalesce(x / F.nullif(of, F.lit(0)), F.lit(0.0))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    same = lambda i, j: F.coalesce(at("_a", i) == at("_b", j), F.lit(False))
    in_two = (F.size("_a") >= 2) & (F.size("_b") >= 2) & (same(1, 2) | same(2, 1))
    return out.withColumns({"place_rate": share(agreed, F.col("_x")), "top_overlap": share(common(first("_a"), first("_b")), F.col("_x")), "overlap": share(common(F.col("_a"), F.col("_b")), F.size(F.array_distinct("_a"))), "first_match": same(1, 1), "first_in_two": in_two}).drop("_a", "_b", "_x")


#: Sizes of both groups below which p is exact if there are no ties.
EXACT_BELOW = 50


@F.pandas_udf(T.DoubleType())
def exact_upper(n1: pd.Series, n0: pd.Series, w: pd.Series) -> pd.Series:
    """Probability of at least w under the rank sum's null distribution, from the numbers of ways to reach each value (coefficients of the Gaussian binomial)."""

    def one(n1, n0, w):
        ways = np.zeros(n1 * n0 + 1)
        ways[0] = 1
        for i in range(1, n1 + 1):  # times (1 - q^(n0 + i)), divided by (1 - q^i)
            if n0 + i < len(ways):
                ways[n0 + i :] -= ways[: len(ways) - n0 - i].copy()
            for r in range(min(i, len(ways))):
                ways[r::i] = np.cumsum(ways[r::i])
        return ways[int(w) :].sum() / ways.sum()

    return pd.Series([None if pd.isna(x) else one(int(a), int(b), x) for a, b, x in zip(n1, n0, w)], dtype="float64")


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: sizes, the rank sum's W of group 1, z with the corrections for continuity and ties, and p that group 1 is larger by chance: exact where both groups have
    fewer than EXACT_BELOW rows and no value comes twice, otherwise from z.

    Rows of neither group, and null or NaN values, are left out. Without rows of both groups, or with one value only, z and p are null; without
    any row W is too, and the sizes are 0. Ranks come from a table of distinct values with running counts, in blocks between quantiles: no task
    orders all rows.
    """
    v = F.col(value).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v) & F.col(group).isin(0, 1))
    counts = own.groupBy(v.alias("v")).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    cuts = counts.agg(F.percentile_approx("v", [k / 256 for k in range(1, 256)]).alias("cuts"))
    sized = counts.withColumn("t", F.col("n1") + F.col("n0")).join(F.broadcast(cuts)).withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
    blocks = sized.groupBy("block").agg(F.sum("t").alias("bt")).withColumn("before", F.coalesce(F.sum("bt").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bt")
    w = Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.join(blocks, "block").withColumn("rank", F.col("before") + F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1") * F.col("rank")).alias("ranks"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    s = s.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n1", "n0")})
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    s = s.withColumn("w", F.col("ranks") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    s = s.withColumn("z", (F.col("w") - n1 * n0 / 2 - 0.5) / F.nullif(spread, F.lit(0.0)))
    exact = (n1 > 0) & (n0 > 0) & (n1 < EXACT_BELOW) & (n0 < EXACT_BELOW) & (F.col("ties") == 0)
    s = s.withColumn("exact", exact_upper(*(F.when(exact, c) for c in (n1, n0, F.col("w")))))
    return s.select(n1.alias("n1"), n0.alias("n0"), "w", "z", F.coalesce("exact", upper_tail(F.col("z"))).alias("p"))


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail by a published rational approximation of five terms (absolute error under 1e-7)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def top_flank(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each flank in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def shortest_annotated(df: DataFrame, keys: list[str], far: Column, row: list[str]) -> DataFrame:
    """For each key the shortest junction whose far end is annotated; ties go to the smallest row."""
    return df.where(far).groupBy(*keys).agg(F.min_by(F.struct(*row), F.struct("length", *row)).alias("r")).select(*keys, "r.*")


def top_novel(df: DataFrame, max_length: int, k: int) -> DataFrame:
    """The k unannotated junctions of at most max_length with the most samples, then coverage."""
    return df.where(~F.col("annotated") & (F.col("length") <= max_length)).orderBy(F.desc("samples_count"), F.desc("coverage_sum"), "feature_id").limit(k)


def sorted_by(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """The whole table in order of one statistic, dealt out by ranges."""
    return df.orderBy(column, *ties)


