"""Gene models: spans, introns, transcripts, splice sites, annotation of junctions, disjoint exons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.intervals import BIN, bins_of_point, bins_of_range, disjoin, islands, overlap_join, prefixed
from spanlake.operators.samples import ROWS, dealt


def gene_spans(tx: DataFrame, max_gap: int = 10_000, gene: str = "gene") -> DataFrame:
    """Spans of a gene on a chromosome: transcripts that overlap the span so far or start within max_gap of its end join it, whatever their input order."""
    marked = islands(tx, [gene, "chrom"], max_gap)
    return marked.groupBy(gene, "chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tx")).drop("island")


def extend_genes(first: DataFrame, second: DataFrame, gene: str = "gene") -> DataFrame:
    """The second annotation's genes replace the first's."""
    return second.unionByName(first.join(second.select(gene).distinct(), gene, "left_anti"))


def by_gene(df: DataFrame, spans: DataFrame, name: str, exact: bool = False, gene: str = "gene", width: int = BIN) -> DataFrame:
    """Features on any span of the gene (upper and lower case alike), or exactly on one."""
    own = spans.where(F.upper(F.col(gene)) == name.upper())
    if exact:
        return df.join(own.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_semi")
    return overlap_join(df, prefixed(own), width).select(*df.columns)


def introns(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Ordinal, start and end of the introns of transcripts with arrays of exon starts (0-based) and ends; on the minus strand they count backwards. Fewer than two exons give none."""
    pairs = F.arrays_zip(F.slice("exon_ends", F.lit(1), F.size("exon_ends") - 1).alias("e"), F.slice("exon_starts", F.lit(2), F.size("exon_starts") - 1).alias("s"))
    ordered = F.when(F.col("strand") == "-", F.reverse(pairs)).otherwise(pairs)
    found = tx.where(F.size("exon_starts") > 1).select(*keys, "strand", F.posexplode(ordered).alias("at", "i"))
    return found.select(*keys, "strand", (F.col("at") + 1).alias("ordinal"), (F.col("i.e") + 1).alias("start"), F.col("i.s").alias("end"))


def gene_introns(all_introns: DataFrame, gene: str, name: str, wanted: list[int | tuple[int, int]]) -> DataFrame:
    """Introns of a gene by ordinals and ranges of ordinals."""
    tests = [F.col("ordinal").between(*w) if isinstance(w, tuple) else F.col("ordinal") == w for w in wanted]
    return all_introns.where((F.col(gene) == name) & reduce(lambda a, b: a | b, tests))


def top_transcripts(tx: DataFrame, spans: DataFrame, limit: int = 20) -> DataFrame:
    """For each gene span (gene, b_chrom, b_start, b_end) its transcripts with the most exons, coding ones first.

    No pair is made: what overlaps a span either begins behind the span's start and not behind its end, or holds its start. The first are dealt to the bins of every
    level that they begin in, the others to the bins that they are made of, each bin keeps its best `limit`, and a span asks the few bins that it is made of and those
    that its start lies in.
    """
    score = (F.col("n_exons") + F.when(F.col("coding"), 100_000).otherwise(0)).alias("score")
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_row.tx"))).where(F.col("rank") <= limit)
    own = best(tx.where("start <= end").select("chrom", "start", "end", score, F.struct(*tx.columns).alias("_row")), "chrom", "start", "end").drop("rank")
    bins = ["chrom", "_holds", "_level", "_bin"]
    dealt = lambda df, holds, nodes, *more: df.select("chrom", F.lit(holds).alias("_holds"), F.explode(nodes).alias("_n"), *more).select("chrom", "_holds", F.col("_n.level").alias("_level"), F.col("_n.bin").alias("_bin"), *more)
    kept = best(dealt(own, False, bins_of_point(F.col("start")), "score", "_row").unionByName(dealt(own, True, bins_of_range(F.col("start"), F.col("end")), "score", "_row")), *bins).drop("rank")
    place = ["b_chrom", "b_start", "b_end"]
    places = spans.where("b_start <= b_end").select(*place, F.col("b_chrom").alias("chrom")).distinct()
    asked = dealt(places, False, bins_of_range(F.col("b_start") + 1, F.col("b_end")), *place).unionByName(dealt(places, True, bins_of_point(F.col("b_start")), *place))
    found = best(asked.join(kept.hint("merge"), bins).select(*place, "score", "_row"), *place)
    named = spans.dropDuplicates(["gene", *place])
    named = named.withColumnsRenamed({c: f"b_{c}" for c in spans.columns if c in tx.columns})
    return found.join(named.hint("merge"), place).select("_row.*", *named.columns, "score", "rank")


def merged_exons(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Exons of a transcript that overlap or leave less than two bases between them, as one."""
    marked = islands(exons, keys, 1)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def splice_sites(exons: DataFrame, tx: str = "tx") -> DataFrame:
    """Distinct (chrom, left, right): the end of an exon and the start of the transcript's next one."""
    merged = merged_exons(dealt(exons.select(tx, "chrom", "start", "end"), ROWS, tx), [tx, "chrom"])
    following = merged.withColumn("right", F.lead("start").over(Window.partitionBy(tx, "chrom").orderBy("start")))
    return following.where("right is not null").select("chrom", F.col("end").alias("left"), "right").distinct()


def annotation_summary(exons: DataFrame, gene: str = "gene", tx: str = "tx") -> DataFrame:
    """One row: genes, transcripts and merged exons, their mean lengths, transcripts of several exons, and the mean length of introns."""
    merged = merged_exons(dealt(exons.select(gene, tx, "chrom", "start", "end"), ROWS, tx), [gene, tx, "chrom"])
    w = Window.partitionBy(gene, tx, "chrom").orderBy("start")
    marked = merged.withColumn("intron", F.lead("start").over(w) - F.col("end") - 1).withColumn("length", F.col("end") - F.col("start") + 1)
    per_tx = marked.groupBy(gene, tx).agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum("intron").alias("introns"), F.count("intron").alias("n_introns"))
    return per_tx.agg(F.countDistinct(gene).alias("n_genes"), F.count("*").alias("n_tx"), F.sum("n").alias("n_exons"), F.avg("length").alias("mean_tx_length"), F.count_if(F.col("n") > 1).alias("n_spliced"), (F.sum("introns") / F.sum("n_introns")).alias("mean_intron_length"))


def genepred_junctions(tx: DataFrame) -> DataFrame:
    """(chrom, start, end, strand) between neighbouring exons, from end + 1 to the next start (0-based); inverted ones go."""
    return introns(tx, ["chrom"]).where(F.col("start") <= F.col("end")).select("chrom", "start", "end", "strand")


def annotation_junctions(junctions: DataFrame) -> DataFrame:
    """Junctions of several sources (column source) as one row each with the sorted distinct sources."""
    return junctions.groupBy("chrom", "start", "end", "strand").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def union_builds(native: DataFrame, lifted: DataFrame, pattern: str) -> DataFrame:
    """Distinct junctions of both on chromosomes that match."""
    return native.unionByName(lifted).where(F.col("chrom").rlike(pattern)).distinct()


def build_counts(native: DataFrame, lifted: DataFrame, pattern: str) -> DataFrame:
    both = native.unionByName(lifted)
    return both.agg(F.count("*").alias("n_before")).join(union_builds(native, lifted, pattern).agg(F.count("*").alias("n_after")))


def annotate(df: DataFrame, known: DataFrame) -> DataFrame:
    """Junctions with annotated (the pair of ends is known), left and right sources (of whatever known junction shares that end) and length.

    known: chrom, start, end, sources. Where it is small Spark broadcasts the three tables made of it.
    """
    ends = lambda side, name: known.select("chrom", side, F.explode("sources").alias("s")).groupBy("chrom", side).agg(F.array_sort(F.collect_set("s")).alias(name))
    pairs = known.select("chrom", "start", "end").distinct().withColumn("_known", F.lit(True))
    out = df.join(pairs, ["chrom", "start", "end"], "left").join(ends("start", "_left"), ["chrom", "start"], "left").join(ends("end", "_right"), ["chrom", "end"], "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"annotated": F.coalesce("_known", F.lit(False)), "left_sources": F.coalesce("_left", none), "right_sources": F.coalesce("_right", none), "length": F.col("end") - F.col("start") + 1}).drop("_known", "_left", "_right")


#: Motifs read on the other strand, and what they are on their own.
MINUS_MOTIFS = {"CT-AC": "GT-AG", "CT-GC": "GC-AG", "GT-AT": "AT-AC"}


def orient_motifs(df: DataFrame, motif: str = "motif") -> DataFrame:
    """Motifs of the minus strand in their own sense, and the strand that the motif tells."""
    table = F.create_map(*(F.lit(x) for pair in MINUS_MOTIFS.items() for x in pair))
    minus = F.col(motif).isin(*MINUS_MOTIFS)
    return df.withColumn("strand", F.when(minus, "-").otherwise("+")).withColumn(motif, F.when(minus, table[F.col(motif)]).otherwise(F.col(motif)))


def motifs(df: DataFrame, sequences: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The two bases at a junction's start and those that end it, from sequences (chrom, seq); N past the end of a sequence.

    Sequences are cut in chunks that overlap by a base, so that no row of the join carries a whole chromosome. Equal junctions each
    come back; a chromosome without a sequence gives NN.
    """
    chunks = sequences.select("chrom", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / width)), lambda i: F.substr("seq", (i * width + 1).cast("int"), F.lit(width + 1)))).alias("chunk", "part"))
    out = df
    for name, at in (("left_motif", F.col("start")), ("right_motif", F.col("end") - 1)):
        side = chunks.select(F.col("chrom").alias("_chrom"), F.col("chunk").alias("_chunk"), F.col("part").alias("_part"))
        chunk = F.floor((at - 1) / width).cast("int")
        two = F.rpad(F.substr(F.coalesce("_part", F.lit("")), (at - chunk * width).cast("int"), F.lit(2)), 2, "N")
        out = out.join(side, (F.col("chrom") == F.col("_chrom")) & (chunk == F.col("_chunk")), "left").withColumn(name, two).drop("_chrom", "_chunk", "_part")
    return out


def consolidate_transcripts(exons: DataFrame) -> DataFrame:
    """Transcripts of several sources (source, tx, chrom, strand, start, end, cds_start, cds_end) with the same coding span and the same chain of inner exon ends, as one: outermost coordinates, ids and sources."""
    chain = F.array_sort(F.collect_list(F.struct("start", "end")))
    tx = exons.groupBy("source", "tx", "chrom", "strand").agg(chain.alias("e"), F.min("cds_start").alias("cds_start"), F.max("cds_end").alias("cds_end"))
    n = F.size("e")
    text = F.array_join(F.transform("e", lambda x, i: F.concat(F.when(i == 0, "").otherwise(x["start"].cast("string")), F.lit("-"), F.when(i == n - 1, "").otherwise(x["end"].cast("string")))), ",")
    tx = tx.select("source", "tx", "chrom", "strand", "cds_start", "cds_end", text.alias("inner"), F.array_min("e.start").alias("start"), F.array_max("e.end").alias("end"))
    return tx.groupBy("chrom", "strand", "cds_start", "cds_end", "inner").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set(F.col("tx").cast("string"))), ";").alias("tx_ids"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def pick_canonical(candidates: DataFrame, key: str = "gene", match: str = "matches", tie: str = "tx") -> DataFrame:
    """One transcript a gene, one that matches exactly if there is any."""
    w = Window.partitionBy(key).orderBy(F.desc(match), tie)
    return candidates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def gene_bp(exons: DataFrame, gene: str = "gene") -> DataFrame:
    """Bases that any exon of a gene covers."""
    return disjoin(exons, [gene, "chrom"]).groupBy(gene).agg(F.sum(F.col("end") - F.col("start") + 1).alias("bp"))


def exon_counts(exons: DataFrame, gene: str = "gene") -> DataFrame:
    """gene and n_exons: how many rows each gene has; null is a gene of its own."""
    return exons.groupBy(gene).agg(F.count("*").alias("n_exons"))


def resolve_gene(df: DataFrame, annotation: DataFrame, key: str, listed: Column) -> DataFrame:
    """For each row the first gene of its list that the annotation (gene, ...) has; rows without any are left out."""
    one = df.select(key, F.posexplode(listed).alias("pos", "gene"))
    return one.join(annotation.select("gene").distinct(), "gene").groupBy(key).agg(F.min_by("gene", "pos").alias("gene"))
