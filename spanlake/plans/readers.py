"""Sources and sinks: views are written in a text layout and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import sources as S
from spanlake.functions import decode_samples, descriptor_part, encode_samples, gene_descriptor
from spanlake.plans.annotation import _transcripts
from spanlake.operators import predicates as P
from spanlake.plans.register import Register
from spanlake.scratch import scratch

register = Register()


def _written(v, lines: DataFrame, header: str | None = None) -> str:
    """A folder with the one text column; a header goes to a file of its own that sorts first only where each file has one."""
    path = scratch(v.spark)
    lines.write.text(path) if header is None else lines.write.option("sep", "\t").option("header", True).csv(path)
    return path


def _row(*columns) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))


_LIST = "coalesce((SELECT string_agg(concat(',', sid, ':', cov), '' ORDER BY sid) FROM cov c WHERE c.feature_id = f.feature_id), '')"


@register(f"""SELECT feature_id, chrom, start, "end", strand, annotated, array_to_string(left_sources, ',') AS left_sources, {_LIST} AS samples, samples_count, coverage_avg FROM features f""")
def s1_read_features(v):
    df = v.features.withColumn("source_id", F.lit(1))
    path = scratch(v.spark)
    S.feature_text(df).write.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    back = S.read_features(v.spark, path)
    return back.select("feature_id", "chrom", "start", "end", "strand", "annotated", F.array_join("left_sources", ",").alias("left_sources"), encode_samples("samples").alias("samples"), "samples_count", "coverage_avg")


@register(f"SELECT feature_id, {_LIST} AS samples, samples_count AS n FROM features f")
def s2_codec(v):
    coded = v.features.select("feature_id", encode_samples("samples").alias("text"))
    return coded.withColumn("s", decode_samples("text")).select("feature_id", encode_samples("s").alias("samples"), F.size("s").cast("long").alias("n"))


@register("SELECT rail_id, accession, CAST(CAST(balance * 100 AS BIGINT) AS VARCHAR) AS cents, tissue FROM samples")
def s3_read_samples(v):
    own = v.samples.select("rail_id", "accession", F.round(F.col("balance") * 100).cast("long").alias("cents"), "tissue")
    return S.read_samples(v.spark, _written(v, own, "header"))


@register("SELECT tissue AS \"group\", study AS long_name, count(*) AS n, string_agg(CAST(rail_id AS VARCHAR), ',' ORDER BY rail_id) AS sids FROM samples GROUP BY 1, 2")
def s4_read_groups(v):
    g = v.samples.groupBy("tissue", "study").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("rail_id")), lambda x: x.cast("string")), ",").alias("ids"))
    back = S.read_groups(v.spark, _written(v, g.select(_row("tissue", "study", "n", "ids"))))
    return back.withColumn("sids", F.array_join(F.transform("sids", lambda x: x.cast("string")), ","))


@register('SELECT chrom, start, "end", sid, value FROM bases')
def s5_read_bases(v):
    path = scratch(v.spark)
    S.write_bases(v.bases, path)
    return S.read_bases(v.spark, path)


@register('SELECT tx AS t, chrom, source, start, "end", strand FROM tx_exons WHERE start < "end" AND tx % 13 <> 0')
def s6_read_gtf(v):
    e = v.tx_exons.withColumn("k", F.col("tx") % 13)
    ids = F.when(F.col("k") == 0, F.lit('gene_id "x";')).otherwise(F.concat(F.lit('gene_id "g'), F.col("gene").cast("string"), F.lit('"; transcript_id "'), F.col("tx").cast("string"), F.lit('"; note "a b";')))
    lines = e.select(_row("chrom", "source", F.lit("exon"), "start", "end", F.lit("."), "strand", F.lit("."), ids).alias("l"))
    lines = lines.unionByName(e.limit(1).select(F.lit("# a comment").alias("l"))).unionByName(e.select(_row("chrom", "source", F.lit("CDS"), "start", "end", F.lit("."), "strand", F.lit("."), ids).alias("l")))
    return S.read_gtf(v.spark, _written(v, lines)).select(F.col("tx").cast("long").alias("t"), "chrom", "source", "start", "end", "strand")


@register('SELECT chrom, start, "end", CAST(gene AS VARCHAR) AS id FROM tx_exons')
def s7_read_gff3(v):
    lines = v.tx_exons.select(_row("chrom", "source", F.lit("gene"), "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), F.col("gene").cast("string"), F.lit(";Name=n"))))
    return S.read_gff3(v.spark, _written(v, lines), "gene").select("chrom", "start", "end", F.col("attributes")["ID"].alias("id"))


@register('SELECT concat(\'G\', gene) AS gene, chrom, min(start) AS start, max("end") AS "end", count(*) AS n_tx FROM tx_exons GROUP BY 1, 2')
def s8_read_gene_symbols(v):
    lines = v.tx_exons.select(_row(F.concat(F.lit("g"), F.col("gene").cast("string")), F.lit("-"), "chrom", "strand", (F.col("start") - 1).cast("string"), "end", F.lit("more")))
    return S.read_gene_symbols(v.spark, _written(v, lines))


def _canonical_lines(v):
    t = _transcripts(v)
    text = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    return t.select("tx", "chrom", "strand", F.element_at("exon_starts", 1).alias("start"), F.element_at("exon_ends", -1).alias("end"), text("exon_starts").alias("s"), text("exon_ends").alias("e"), F.size("exon_starts").alias("n"))


_ARRAYS = """(SELECT tx, chrom, strand, min(start) - 1 AS start, max("end") AS "end", count(*) AS n, string_agg(CAST(start - 1 AS VARCHAR), ',' ORDER BY start) AS exon_starts, string_agg(CAST("end" AS VARCHAR), ',' ORDER BY start) AS exon_ends FROM {0} GROUP BY 1, 2, 3)"""


def _merged_sql() -> str:
    from spanlake.plans.annotation import _MERGED

    return _MERGED


def _text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@register(f'SELECT CAST(tx AS VARCHAR) AS tx, chrom, start, "end", exon_starts, exon_ends FROM {_ARRAYS.format(_merged_sql())}')
def s8_read_canonical(v):
    lines = _canonical_lines(v).select(_row("tx", "chrom", "strand", "start", "end", "s", "e", F.lit("gene")))
    return S.read_canonical(v.spark, _written(v, lines)).select("tx", "chrom", "start", "end", _text("exon_starts"), _text("exon_ends"))


@register(f'SELECT CAST(tx AS VARCHAR) AS tx, chrom, start + 1 AS start, "end", tx % 2 = 0 AS coding, CAST(n AS INTEGER) AS n_exons FROM {_ARRAYS.format(_merged_sql())}')
def s8_read_transcripts(v):
    own = _transcripts(v)
    exons = F.array_join(F.zip_with("exon_starts", "exon_ends", lambda s, e: F.concat_ws("-", (s + 1).cast("string"), e.cast("string"))), ",")
    span = F.when(F.col("tx") % 2 == 0, "1-2").otherwise("")
    lines = own.select(_row("chrom", F.lit("src"), F.lit("transcript"), (F.element_at("exon_starts", 1) + 1).cast("string"), F.element_at("exon_ends", -1).cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("transcript_id "), F.col("tx").cast("string"), F.lit("; cds_span "), span, F.lit("; exons "), exons)))
    return S.read_transcripts(v.spark, _written(v, lines)).select("tx", "chrom", "start", "end", "coding", "n_exons")


@register("SELECT chrom, start, \"end\", sid, cov FROM cov c JOIN features f ON f.feature_id = c.feature_id")
def s9_read_raw_junctions(v):
    part = lambda k: F.array_join(F.transform("samples", lambda s: s[k].cast("string")), ",")
    lines = v.features.where(F.size("samples") > 0).select(_row("chrom", "strand", "start", "end", part("sid"), part("cov")))
    back = S.read_raw_junctions(v.spark, _written(v, lines))
    return back.select("chrom", "start", "end", F.explode(F.arrays_zip("sids", "covs")).alias("x")).select("chrom", "start", "end", F.col("x.sids").alias("sid"), F.col("x.covs").alias("cov"))


@register('SELECT DISTINCT chrom, start, "end" FROM repeats')
def s10_read_repeats(v):
    dots = [F.lit(".")] * 5
    lines = v.repeats.select(_row(*dots, "chrom", (F.col("start") - 1).cast("string"), "end", F.lit("."), "strand", "rep", "class"))
    return S.read_repeats(v.spark, _written(v, lines)).select("chrom", "start", "end")


@register(f"SELECT CAST(tx AS VARCHAR) AS tx, chrom, exon_starts, exon_ends FROM {_ARRAYS.format(_merged_sql())}")
def s11_read_genepred(v):
    lines = _canonical_lines(v).select(_row(F.lit("bin"), "tx", "chrom", "strand", "start", "end", "start", "end", "n", "s", "e"))
    return S.read_genepred(v.spark, _written(v, lines), 1).select("tx", "chrom", _text("exon_starts"), _text("exon_ends"))


@register('SELECT feature_id, chrom, start, "end" FROM features')
def s12_write_clustered(v):
    path = scratch(v.spark)
    S.write_clustered(v.features.select("feature_id", "chrom", "start", "end"), path)
    return v.spark.read.parquet(path).select("feature_id", "chrom", "start", "end")


@register('SELECT feature_id, chrom, start, "end" FROM features WHERE chrom = \'Brand#7\' AND "end" >= 3000 AND start <= 5000')
def s12_levelled_scan(v):
    """Features laid out by level and start, and a region read from there."""
    path = scratch(v.spark)
    S.write_levelled(v.features.select("feature_id", "chrom", "start", "end"), path, width=100)
    return P.overlaps(v.spark.read.parquet(path), "Brand#7", 3000, 5000, levels="level", width=100).select("feature_id", "chrom", "start", "end")


@register("SELECT concat('TEST:J', chr(9), feature_id, chr(9), chrom, chr(9), samples_count) AS value FROM features")
def s13_tsv_rows(v):
    path = scratch(v.spark)
    S.write_tsv(v.features, path, "TEST:J", ["feature_id", "chrom", "samples_count"])
    return v.spark.read.text(path)


@register('SELECT chrom, start - 1 AS chrom_start, "end" AS chrom_end, CAST(feature_id AS VARCHAR) AS name, coverage_sum AS score, strand FROM features')
def s14_bed(v):
    return S.to_bed(v.features, "coverage_sum")


@register('SELECT chrom, start, "end", sum(value) AS value FROM bases GROUP BY 1, 2, 3')
def s15_bedgraph(v):
    return S.to_bedgraph(v.bases)


def _order(v):
    return v.samples.select(F.col("rail_id").alias("sid"), (F.col("rail_id") + 1).alias("column"))


_ROWS = "(SELECT feature_id AS fid, row_number() OVER (ORDER BY chrom, start, feature_id) AS row FROM features)"


_SIZES = "SELECT concat_ws(' ', (SELECT count(*) FROM features), (SELECT count(*) FROM samples), (SELECT count(*) FROM cov)) AS value UNION ALL SELECT '%%MatrixMarket matrix coordinate integer general'"


@register(f"SELECT concat_ws(' ', row, sid + 1, cov) AS value FROM cov JOIN {_ROWS} ON fid = feature_id UNION ALL {_SIZES}")
def s17_matrix_market(v):
    path = scratch(v.spark)
    S.write_matrix_market(v.features, path, _order(v))
    return v.spark.read.text(path)


@register(_SIZES)
def s17_matrix_market_header(v):
    path = scratch(v.spark)
    S.write_matrix_market(v.features, path, _order(v))
    lines = v.spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    told = lines.agg(F.min("file").alias("file"), (F.count("*") - 2).cast("string").alias("n"))
    return lines.join(F.broadcast(told), "file").where("value like '\\%%' or split_part(value, ' ', 3) = n").select("value")


_ASIA = "(SELECT rail_id AS a_sid, row_number() OVER (ORDER BY rail_id) AS col FROM samples WHERE study = 'ASIA')"


@register(f"""WITH e AS (SELECT f.feature_id, chrom, start, col, cov FROM cov c JOIN {_ASIA} ON a_sid = sid JOIN features f ON f.feature_id = c.feature_id), r AS (SELECT feature_id AS fid, row_number() OVER (ORDER BY chrom, start, feature_id) AS row FROM (SELECT DISTINCT feature_id, chrom, start FROM e))
SELECT row, col AS "column", cov AS value FROM e JOIN r ON fid = feature_id""")
def s18_matrix_market_restricted(v):
    keep = v.samples.where("study = 'ASIA'").select(F.col("rail_id").alias("sid"))
    return S.matrix_market(v.features, _order(v), keep)[0]


@register("SELECT CAST(feature_id AS VARCHAR) AS name, CAST(least(1000, floor(ln(samples_count) * 200)) AS BIGINT) AS score FROM features WHERE samples_count > 0")
def s19_scored_bed(v):
    return S.to_scored_bed(v.features.where("samples_count > 0")).select("name", "score")


@register('SELECT chrom, start - 1 AS s, "end" AS e, strand FROM features')
def s20_bed_shards(v):
    path = scratch(v.spark)
    S.write_bed_shards(v.features, path, 100)
    return v.spark.read.option("sep", "\t").schema("chrom string, s long, e long, a string, b string, strand string").csv(path).select("chrom", "s", "e", "strand")


@register("SELECT * FROM (VALUES ('parts', 'p_size', 'i'), ('parts', 'p_name', 't'), ('events', 'value', 'f'), ('events', 'user_id', 'i')) t(dataset, field, type)")
def s22_registry(v):
    out = S.registry({"parts": v.table("part").select("p_size", "p_name"), "events": v.table("events").select("value", "user_id")})
    return out.select("dataset", F.explode("fields").alias("field", "type"))


@register("SELECT CAST(ordinal AS BIGINT) AS ordinal, field, type, (SELECT count(*) FROM cov) AS n_values FROM (VALUES (0, 'feature_id', 'bigint'), (1, 'sid', 'bigint'), (2, 'cov', 'bigint')) t(ordinal, field, type)")
def s23_fields_table(v):
    return S.fields_table(v.cov)


@register("SELECT p_partkey, concat_ws(':', p_partkey, p_brand, p_type, p_size) AS descriptor, p_type AS kind FROM part")
def s24_gene_descriptor(v):
    out = v.table("part").select("p_partkey", gene_descriptor("p_partkey", "p_brand", "p_type", "p_size").alias("descriptor"))
    return out.withColumn("kind", descriptor_part("descriptor", 3))
