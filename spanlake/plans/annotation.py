"""Gene models and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import genes as G
from spanlake.operators import predicates as P
from spanlake.operators.intervals import disjoin, prefixed
from spanlake.operators.samples import ROWS, dealt
from spanlake.plans.register import Register

register = Register()

_SPANS = """(SELECT gene, chrom, min(start) AS start, max("end") AS "end", count(*) AS n_tx FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {0} THEN 1 ELSE 0 END) OVER (PARTITION BY gene, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, max("end") OVER (PARTITION BY gene, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT gene, chrom, start, "end" FROM tx_exons))) GROUP BY gene, chrom, island)"""


def _spans(v, gap=20):
    return G.gene_spans(v.tx_exons.select("gene", "chrom", "start", "end").distinct(), gap)


@register(f"SELECT * FROM {_SPANS.format(20)}")
def g1_gene_spans(v):
    return _spans(v)


@register(f'SELECT gene, start, "end" FROM {_SPANS.format(200)} WHERE gene % 3 = 0 UNION ALL SELECT gene, start, "end" FROM {_SPANS.format(20)} WHERE gene % 3 <> 0')
def g2_extend_genes(v):
    columns = ["gene", "start", "end"]
    return G.extend_genes(_spans(v).select(columns), _spans(v, 200).where("gene % 3 = 0").select(columns))


@register(f"SELECT f.feature_id FROM features f JOIN {_SPANS.format(20)} s ON f.chrom = s.chrom AND f.\"end\" >= s.start AND f.start <= s.\"end\" WHERE s.gene = 17")
def g3_by_gene(v):
    named = _spans(v).withColumn("gene", F.concat(F.lit("Gene"), F.col("gene").cast("string")))
    return G.by_gene(v.features, named, "GENE17").select("feature_id")


@register("SELECT f.feature_id FROM features f JOIN features s ON s.chrom = f.chrom AND s.start = f.start AND s.\"end\" = f.\"end\" WHERE s.feature_id % 100 = 34")
def g4_by_gene_exact(v):
    spans = v.features.select(F.concat(F.lit("ENSG"), (F.col("feature_id") % 100).cast("string"), F.lit(".2")).alias("gene"), "chrom", "start", "end")
    return G.by_gene(v.features, spans, "ensg34.2", exact=True).select("feature_id")


_MERGED = """(SELECT tx, chrom, strand, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, max("end") OVER (PARTITION BY tx ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT tx, chrom, strand, start, "end" FROM tx_exons))) GROUP BY tx, chrom, strand, island)"""
_INTRONS = f"""(SELECT tx, chrom, strand, CASE WHEN strand = '-' THEN n - k ELSE k END AS ordinal, "end" + 1 AS start, nxt - 1 AS "end" FROM
 (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY start) AS k, count(*) OVER (PARTITION BY tx) AS n, lead(start) OVER (PARTITION BY tx ORDER BY start) AS nxt FROM {_MERGED}) WHERE nxt IS NOT NULL)"""


def _transcripts(v):
    """Merged exons as arrays, starts 0-based."""
    merged = G.merged_exons(dealt(v.tx_exons.select("tx", "chrom", "strand", "start", "end"), ROWS, "tx").distinct(), ["tx", "chrom", "strand"])
    lists = merged.groupBy("tx", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("e"))
    return lists.select("tx", "chrom", "strand", F.transform("e", lambda x: x["start"] - 1).alias("exon_starts"), F.transform("e", lambda x: x["end"]).alias("exon_ends"))


@register(f'SELECT tx, chrom, strand, CAST(ordinal AS INTEGER) AS ordinal, start, "end" FROM {_INTRONS}')
def g5_introns(v):
    return G.introns(_transcripts(v), ["tx", "chrom"])


@register(f'SELECT tx, CAST(ordinal AS INTEGER) AS ordinal, start, "end" FROM {_INTRONS} WHERE tx = 21 AND (ordinal = 1 OR ordinal BETWEEN 3 AND 5)')
def g6_gene_introns(v):
    return G.gene_introns(G.introns(_transcripts(v), ["tx", "chrom"]), "tx", 21, [1, (3, 5)]).select("tx", "ordinal", "start", "end")


_TX = '(SELECT tx, gene, chrom, min(start) AS start, max("end") AS "end", count(*) AS n_exons, tx % 3 = 0 AS coding FROM tx_exons GROUP BY tx, gene, chrom)'


def _tx(v):
    return v.tx_exons.groupBy("tx", "gene", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_exons")).withColumn("coding", F.col("tx") % 3 == 0)


@register(f"SELECT tx, start, \"end\" FROM {_TX} WHERE chrom = 'Brand#7' AND \"end\" >= 2000 AND start <= 4000")
def g7_transcripts_in_region(v):
    return P.overlaps(_tx(v), "Brand#7", 2000, 4000).select("tx", "start", "end")


@register(f"""SELECT gene, b_start, tx, rank FROM (SELECT s.gene, s.start AS b_start, tx, CAST(row_number() OVER (PARTITION BY s.gene, s.chrom, s.start, s."end" ORDER BY n_exons + CASE WHEN coding THEN 100000 ELSE 0 END DESC, tx) AS INTEGER) AS rank
 FROM (SELECT tx, chrom, start, "end", n_exons, coding FROM {_TX}) t JOIN {_SPANS.format(20)} s ON t.chrom = s.chrom AND t."end" >= s.start AND t.start <= s."end") WHERE rank <= 3""")
def g8_top_transcripts(v):
    return G.top_transcripts(_tx(v).drop("gene"), prefixed(_spans(v), "gene"), 3).select("gene", "b_start", "tx", "rank")


@register(f'SELECT DISTINCT chrom, start - 1 AS "left", "end" + 1 AS "right" FROM {_INTRONS}')
def g9_splice_sites(v):
    return G.splice_sites(v.tx_exons)


@register(f"""WITH m AS {_MERGED}, p AS (SELECT tx, count(*) AS n, sum("end" - start + 1) AS length FROM m GROUP BY 1), i AS (SELECT sum("end" - start + 1) AS s, count(*) AS c FROM {_INTRONS})
SELECT (SELECT count(DISTINCT tx // 2) FROM m) AS n_genes, count(*) AS n_tx, CAST(sum(n) AS BIGINT) AS n_exons, avg(length) AS mean_tx_length, count(*) FILTER (n > 1) AS n_spliced, CAST((SELECT s FROM i) AS DOUBLE) / (SELECT c FROM i) AS mean_intron_length FROM p""")
def g10_annotation_summary(v):
    return G.annotation_summary(v.tx_exons)


@register(f'SELECT chrom, strand, start, "end" FROM {_INTRONS} WHERE start <= "end"')
def g11_genepred_junctions(v):
    return G.genepred_junctions(_transcripts(v))


@register("""SELECT chrom, start, "end", strand, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM tx_exons GROUP BY 1, 2, 3, 4""")
def g12_annotation_junctions(v):
    return G.annotation_junctions(v.tx_exons).withColumn("sources", F.array_join("sources", ","))


_BUILDS = 'SELECT chrom, start, "end" FROM exons WHERE exon % 2 = 0 UNION ALL SELECT chrom, start, "end" FROM exons WHERE exon % 5 = 0'


def _builds(v):
    columns = ["chrom", "start", "end"]
    return v.exons.where("exon % 2 = 0").select(columns), v.exons.where("exon % 5 = 0").select(columns), r"^Brand#[0-9]$"


@register(f"SELECT DISTINCT * FROM ({_BUILDS}) WHERE regexp_full_match(chrom, 'Brand#[0-9]')")
def g13_union_builds(v):
    return G.union_builds(*_builds(v))


@register(f"SELECT (SELECT count(*) FROM ({_BUILDS})) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_BUILDS}) WHERE regexp_full_match(chrom, 'Brand#[0-9]'))) AS n_after")
def g13_build_counts(v):
    return G.build_counts(*_builds(v))


@register("""WITH k AS (SELECT chrom, start, "end", source FROM exons WHERE exon % 2 = 0), l AS (SELECT chrom, start, string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM k GROUP BY 1, 2), r AS (SELECT chrom, "end", string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM k GROUP BY 1, 2)
SELECT e.exon, EXISTS (SELECT 1 FROM k WHERE k.chrom = e.chrom AND k.start = e.start AND k."end" = e."end") AS annotated, coalesce(l.s, '') AS left_sources, coalesce(r.s, '') AS right_sources, e."end" - e.start + 1 AS length
FROM exons e LEFT JOIN l ON l.chrom = e.chrom AND l.start = e.start LEFT JOIN r ON r.chrom = e.chrom AND r."end" = e."end" """)
def g14_annotate(v):
    known = v.exons.where("exon % 2 = 0").groupBy("chrom", "start", "end").agg(F.collect_set("source").alias("sources"))
    out = G.annotate(v.exons.select("exon", "chrom", "start", "end"), known)
    return out.select("exon", "annotated", F.array_join("left_sources", ",").alias("left_sources"), F.array_join("right_sources", ",").alias("right_sources"), "length")


@register("SELECT feature_id, CASE feature_id % 3 WHEN 0 THEN 'GT-AG' ELSE 'GT-AG' END AS motif, CASE feature_id % 3 WHEN 0 THEN '-' ELSE '+' END AS strand FROM features")
def g15_orient_motifs(v):
    own = v.features.select("feature_id", "strand", F.concat_ws("-", "left_motif", "right_motif").alias("motif"))
    return G.orient_motifs(own)


@register("""SELECT doc_id, p, rpad(substr(text, p, 2), 2, 'N') AS left_motif, rpad(substr(text, p + 300, 2), 2, 'N') AS right_motif FROM documents, (VALUES (1), (64), (500)) t(p)""")
def g16_motifs(v):
    seq = v.table("documents").select(F.col("doc_id").cast("string").alias("chrom"), F.col("text").alias("seq"))
    jx = v.table("documents").select("doc_id", F.col("doc_id").cast("string").alias("chrom"), F.explode(F.array(F.lit(1), F.lit(64), F.lit(500))).alias("p"))
    jx = jx.select("doc_id", "chrom", "p", F.col("p").cast("long").alias("start"), (F.col("p") + 301).cast("long").alias("end"))
    return G.motifs(jx, seq, 64).select("doc_id", "p", "left_motif", "right_motif")


_CDS = "SELECT source, tx // 4 AS tx, chrom, '+' AS strand, start, \"end\", (tx // 8) * 10 AS cds_start, (tx // 8) * 10 + 500 AS cds_end FROM (SELECT DISTINCT source, tx - tx % 4 AS tx, 'c' AS chrom, (start // 700) * 700 + 1 AS start, (start // 700) * 700 + 300 + (start // 700) % 2 AS \"end\" FROM tx_exons)"


@register(f"""WITH x AS ({_CDS}), t AS (SELECT source, tx, chrom, strand, cds_start, cds_end, list(start ORDER BY start) AS s, list("end" ORDER BY start) AS e FROM x GROUP BY ALL),
i AS (SELECT *, array_to_string(list_transform(range(1, len(s) + 1), lambda k: concat(CASE WHEN k = 1 THEN '' ELSE CAST(s[k] AS VARCHAR) END, '-', CASE WHEN k = len(s) THEN '' ELSE CAST(e[k] AS VARCHAR) END)), ',') AS "inner" FROM t)
SELECT chrom, strand, cds_start, cds_end, "inner", min(list_min(s)) AS start, max(list_max(e)) AS "end", string_agg(DISTINCT CAST(tx AS VARCHAR), ';' ORDER BY CAST(tx AS VARCHAR)) AS tx_ids, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM i GROUP BY ALL""")
def g17_consolidate_transcripts(v):
    tx, cut = F.col("tx") - F.col("tx") % 4, F.floor(F.col("start") / 700)
    x = v.tx_exons.select("source", tx.alias("tx"), F.lit("c").alias("chrom"), (cut * 700 + 1).alias("start"), (cut * 700 + 300 + cut % 2).alias("end")).distinct()
    x = x.select("source", F.floor(F.col("tx") / 4).alias("tx"), "chrom", F.lit("+").alias("strand"), "start", "end", (F.floor(F.col("tx") / 8) * 10).alias("cds_start"), (F.floor(F.col("tx") / 8) * 10 + 500).alias("cds_end"))
    return G.consolidate_transcripts(x)


@register("SELECT p_brand AS gene, p_partkey AS tx FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size = 25) DESC, p_partkey) AS k FROM part) WHERE k = 1")
def g18_pick_canonical(v):
    own = v.table("part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("tx"), (F.col("p_size") == 25).alias("matches"))
    return G.pick_canonical(own).select("gene", "tx")


_DISJOINT = """(WITH c AS (SELECT gene, start AS pt FROM tx_exons UNION SELECT gene, "end" + 1 FROM tx_exons), s AS (SELECT gene, pt AS start, lead(pt) OVER (PARTITION BY gene ORDER BY pt) - 1 AS "end" FROM c)
 SELECT * FROM s WHERE "end" IS NOT NULL AND EXISTS (SELECT 1 FROM tx_exons t WHERE t.gene = s.gene AND t.start <= s.start AND t."end" >= s."end"))"""


@register(f'SELECT gene, start, "end" FROM {_DISJOINT}')
def g19_disjoin(v):
    return disjoin(v.tx_exons, ["gene"])


@register("""SELECT gene, CAST(sum(bp) AS BIGINT) AS bp FROM (SELECT gene, chrom, count(DISTINCT p) AS bp FROM (SELECT gene, chrom, unnest(range(start, "end" + 1)) AS p FROM tx_exons) GROUP BY 1, 2) GROUP BY 1""")
def g20_gene_bp(v):
    return G.gene_bp(v.tx_exons)


@register("SELECT gene, count(*) AS n_exons FROM tx_exons GROUP BY 1")
def g21_exon_counts(v):
    return G.exon_counts(v.tx_exons)


@register("SELECT feature_id, CAST(CASE WHEN feature_id % 3 = 0 THEN feature_id % 400 ELSE feature_id % 400 + 1 END AS VARCHAR) AS gene FROM features WHERE (feature_id % 3 = 0 OR feature_id % 3 = 2)")
def g22_resolve_gene(v):
    k = F.col("feature_id")
    listed = F.concat_ws(";", F.when(k % 3 == 0, (k % 400).cast("string")).otherwise("none"), F.when(k % 3 == 1, "no").otherwise((k % 400 + 1).cast("string")))
    known = v.spark.range(401).select(F.col("id").cast("string").alias("gene"))
    return G.resolve_gene(v.features.select("feature_id", F.split(listed, ";").alias("l")), known, "feature_id", F.col("l"))
