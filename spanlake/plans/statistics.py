"""Aggregations, normalisation, types, merging, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import row_key
from spanlake.operators import flank as X
from spanlake.operators import intervals as I
from spanlake.operators import stats as A
from spanlake.operators.samples import long
from spanlake.plans.register import Register

register = Register()

_STATS = "samples_count, coverage_sum, coverage_avg, coverage_median"


@register(f"SELECT feature_id, {_STATS} FROM features")
def a1_feature_stats(v):
    return A.feature_stats(v.features.select("feature_id", "samples")).drop("samples")


@register("SELECT feature_id, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, avg(cov) AS coverage_avg, CAST(median(cov) AS DOUBLE) AS coverage_median FROM cov GROUP BY 1")
def a1_long_stats(v):
    return A.long_stats(v.cov)


@register("SELECT sid, count(cov) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, avg(cov) AS coverage_avg, CAST(median(cov) AS DOUBLE) AS coverage_median FROM cov GROUP BY 1")
def a1_long_keys(v):
    """Statistics of each sample's coverage over all features, medians from divided values."""
    return A.long_stats(v.cov, "sid", spread=True)


@register("SELECT s.rail_id, s.tissue, count(c.sid) AS n_features, CAST(coalesce(sum(cov), 0) AS BIGINT) AS coverage, coalesce(avg(cov), 0e0) AS mean_coverage FROM samples s LEFT JOIN (SELECT * FROM cov WHERE cov >= 30) c ON sid = rail_id GROUP BY 1, 2")
def a2_sample_stats(v):
    return A.sample_stats(v.cov.where("cov >= 30"), v.samples.select("rail_id", "tissue"), "rail_id")


@register('SELECT chrom, start, "end", sum(value) / 150 AS value FROM bases GROUP BY 1, 2, 3')
def a3_bases_by_row_mean(v):
    return A.bases_by_row(v.bases, 150, "mean")


@register('SELECT chrom, start, "end", sum(value) AS value FROM bases GROUP BY 1, 2, 3')
def a3_bases_by_row_sum(v):
    return A.bases_by_row(v.bases, 150)


@register("SELECT 'click' AS label, sid, sum(value) / (SELECT count(DISTINCT start) FROM bases WHERE chrom = 'click') AS value FROM bases WHERE chrom = 'click' GROUP BY sid")
def a4_bases_by_sample_mean(v):
    return A.bases_by_sample(v.bases.where("chrom = 'click'"), "click", "mean")


@register("SELECT 'click' AS label, sid, sum(value) AS value FROM bases WHERE chrom = 'click' GROUP BY sid")
def a4_bases_by_sample_sum(v):
    return A.bases_by_sample(v.bases.where("chrom = 'click'"), "click")


@register('SELECT chrom, start, "end", sum(value) AS total, count(*) FILTER (value >= 10000) AS n_over, sum(value) / ("end" - start) AS per_base FROM bases GROUP BY 1, 2, 3')
def a5_bases_summary(v):
    return A.bases_summary(v.bases, 10000)


_WEEKS = "(SELECT DISTINCT concat(chrom, ':', start // 168) AS label, chrom AS b_chrom, (start // 168) * 168 + 1 AS b_start, (start // 168) * 168 + 100 AS b_end FROM bases)"


@register(f'SELECT label, sid, chrom, min(start) + 1 AS start, max("end") AS "end", sum(value) AS value, max("end") - min(start) AS length FROM bases JOIN {_WEEKS} ON chrom = b_chrom AND "end" >= b_start AND start + 1 <= b_end GROUP BY 1, 2, 3')
def a6_interval_sums(v):
    week = F.floor(F.col("start") / 168)
    named = v.bases.select(F.concat_ws(":", "chrom", week.cast("string")).alias("label"), F.col("chrom").alias("b_chrom"), (week * 168 + 1).alias("b_start"), (week * 168 + 100).alias("b_end")).distinct()
    return A.interval_sums(v.bases, named, 100)


@register("""SELECT split_part(p_name, ' ', 1) AS part, CAST(sum(length) AS BIGINT) AS length, min(start) AS start, max("end") AS "end", CAST(sum(coverage_sum) AS BIGINT) AS coverage_sum FROM features JOIN part ON p_partkey = feature_id GROUP BY 1""")
def a7_rollup_key(v):
    named = v.features.join(v.table("part").select(F.col("p_partkey").alias("feature_id"), "p_name"), "feature_id")
    return A.rollup_key(named, "p_name", 1, " ", ["coverage_sum"])


@register("SELECT p_brand AS gene, sid, CAST(sum(cov) AS BIGINT) AS cov FROM cov JOIN part ON p_partkey = feature_id GROUP BY 1, 2")
def a8_exon_to_gene(v):
    return A.exon_to_gene(v.cov.withColumnRenamed("feature_id", "ordinal"), v.table("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("gene")))


@register("SELECT c.feature_id, string_agg(concat(sid + 5, ':', cov), ',' ORDER BY sid) AS samples FROM cov c WHERE sid < 8 AND sid <> 3 GROUP BY 1")
def a9_sparse_from_wide(v):
    wide = v.cov.groupBy("feature_id").pivot("sid", list(range(8))).agg(F.sum("cov"))
    wide = wide.select("feature_id", *(F.coalesce(F.col(str(s)), F.lit(0)).alias(f"acc{s}") for s in range(8)))
    ids = v.spark.createDataFrame([(f"ACC{s}", s + 5) for s in range(8) if s != 3], "accession string, sid long")
    out = A.sparse_from_wide(wide, ["feature_id"], ids, truncate=True)
    return out.select("feature_id", F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s["sid"].cast("string"), s["cov"].cast("string"))), ",").alias("samples"))


_MEAN = "(sum(cov) FILTER (study = '{0}') / CAST((SELECT count(*) FROM samples WHERE study = '{0}') AS DOUBLE))"


@register("SELECT feature_id AS gene, " + ", ".join(f"CASE WHEN {_MEAN.format(s)} >= 1 THEN round(ln({_MEAN.format(s)}), 1) ELSE 0e0 END AS \"{s}\"" for s in ("AFRICA", "AMERICA", "ASIA")) + " FROM cov LEFT JOIN samples ON rail_id = sid GROUP BY 1")
def a10_group_means(v):
    groups = v.samples.select(F.col("rail_id").alias("sid"), F.col("study").alias("group"))
    return A.group_means(v.cov.withColumnRenamed("feature_id", "gene"), groups, ["AFRICA", "AMERICA", "ASIA"])


@register("SELECT feature_id, tissue AS parent, sum(cov) / CAST(any_value(size) AS DOUBLE) AS value FROM cov JOIN samples USING_ ON rail_id = sid JOIN (SELECT tissue AS t, count(*) AS size FROM samples GROUP BY 1) ON t = tissue GROUP BY 1, 2".replace(" USING_", ""))
def a11_normalised_by_parent(v):
    return A.normalised_by_parent(v.cov, v.samples.select(F.col("rail_id").alias("sid"), F.col("tissue").alias("parent")))


_STUDIES = """(SELECT feature_id, study, CAST(n * 100 // sum(n) OVER (PARTITION BY feature_id) AS INTEGER) AS samples_percent, CAST(c * 100 // sum(c) OVER (PARTITION BY feature_id) AS INTEGER) AS coverage_percent
 FROM (SELECT feature_id, study, count(*) AS n, CAST(sum(cov) AS BIGINT) AS c FROM cov JOIN samples ON rail_id = sid GROUP BY 1, 2))"""


@register(f"SELECT *, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY samples_percent DESC, coverage_percent DESC, study) AS INTEGER) AS rank FROM {_STUDIES} WHERE samples_percent > 0")
def a12_feature_studies(v):
    return A.feature_studies(v.cov, v.samples.select(F.col("rail_id").alias("sid"), "study"))


@register(f"SELECT x.feature_id, study, samples_percent FROM {_STUDIES} x JOIN features f ON f.feature_id = x.feature_id WHERE samples_percent > 0 AND chrom = 'Brand#7' AND \"end\" >= 3000 AND start <= 5000")
def a13_studies_of(v):
    from spanlake.operators.predicates import overlaps

    own = overlaps(v.features, "Brand#7", 3000, 5000)
    return A.feature_studies(long(own), v.samples.select(F.col("rail_id").alias("sid"), "study")).select("feature_id", "study", "samples_percent")


@register(r"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 0 THEN 'NA' ELSE CAST(p_retailprice AS VARCHAR) END AS mixed,
CASE WHEN p_partkey % 2 = 0 THEN 'NA' ELSE ' ' END AS nothing, CASE p_partkey % 9 WHEN 0 THEN '1.5' WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE '7' END AS beaten FROM part),
u AS (FROM p UNPIVOT (value FOR field IN (p_partkey, p_name, p_brand, p_size, p_retailprice, mixed, nothing, beaten))),
k AS (SELECT field, CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN 'i' WHEN regexp_full_match(value, '-?[0-9]+\.?[0-9]+') OR contains(value, 'e+') THEN 'f' WHEN value = 'NA' OR trim(value) = '' THEN 'n' ELSE 't' END AS kind FROM u),
n AS (SELECT field, count(*) FILTER (kind = 'i') AS i, count(*) FILTER (kind = 'f') AS f, count(*) FILTER (kind = 't') AS t FROM k GROUP BY 1),
r AS (SELECT field, CASE WHEN f > 0 THEN 0 ELSE i END AS i, f, t, i + f + t = 0 AS empty FROM n) SELECT field, CASE WHEN empty THEN 'n' WHEN t >= greatest(i, f) THEN 't' WHEN f > i THEN 'f' ELSE 'i' END AS type FROM r""")
def a14_infer_types(v):
    p = v.table("part").withColumn("mixed", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 0, "NA").otherwise(F.col("p_retailprice").cast("string")))
    k = F.col("p_partkey") % 9
    p = p.withColumns({"nothing": F.when(F.col("p_partkey") % 2 == 0, "NA").otherwise(" "), "beaten": F.when(k == 0, "1.5").when(k == 1, "x").when(k == 2, "y").otherwise("7")})
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", "mixed", "nothing", "beaten"]
    return A.infer_types(p.select(*(F.col(c).cast("string").alias(c) for c in columns)), columns)


@register("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part")
def a15_apply_types(v):
    p = v.table("part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.when(F.col("p_partkey") % 9 == 0, "x1").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"))
    return A.apply_types(p, {"p_partkey": "i", "p_size": "i", "p_retailprice": "f"})


_RUNS = """(SELECT dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) AS run, chrom, start, "end", strand, l_suppkey AS sid, CAST(l_quantity AS BIGINT) AS cov FROM lineitem JOIN features ON feature_id = l_partkey)"""


@register(f"""WITH r AS (SELECT run, chrom, start, "end", strand, sid, CAST(sum(cov) AS BIGINT) AS cov FROM {_RUNS} GROUP BY ALL), a AS (SELECT sid, min(run * 1000 + sid) AS first FROM r WHERE sid % 2 = 0 GROUP BY 1),
m AS (SELECT run, chrom, start, "end", strand, coalesce(first, run * 1000 + r.sid) AS sid, cov FROM r LEFT JOIN a ON r.sid = a.sid)
SELECT chrom, start, "end", arg_min(strand, run) AS strand, string_agg(concat(sid, ':', cov), ',' ORDER BY sid, cov) AS samples FROM m GROUP BY 1, 2, 3""")
def a17_merge_runs(v):
    from pyspark.sql import Window

    t = v.table("lineitem").select("l_returnflag", "l_linestatus", F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sid"), F.col("l_quantity").cast("long").alias("cov"))
    flags = t.select("l_returnflag", "l_linestatus").distinct().withColumn("run", F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus")))
    entries = t.join(F.broadcast(flags), ["l_returnflag", "l_linestatus"]).join(v.features.select("feature_id", "chrom", "start", "end", "strand"), "feature_id")
    entries = entries.groupBy("run", "chrom", "start", "end", "strand", "sid").agg(F.sum("cov").alias("cov"))
    accessions = entries.where("sid % 2 = 0").select("run", "sid", F.col("sid").cast("string").alias("accession")).distinct()
    out = A.merge_runs(entries, accessions, 1000)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s["sid"].cast("string"), s["cov"].cast("string"))), ","))


@register("SELECT count(*) AS n_features, CAST(sum(samples_count) AS BIGINT) AS n_entries, avg(samples_count) AS mean_samples FROM features")
def a18_table_summary(v):
    return A.table_summary(v.features)


@register("SELECT tissue, count(*) AS n, CAST(row_number() OVER (ORDER BY tissue) - 1 AS INTEGER) AS id FROM samples GROUP BY tissue")
def a19_dense_ids(v):
    return A.dense_ids_of(v.samples, "tissue")


@register("SELECT p_type, count(*) AS n FROM part JOIN features ON feature_id = p_partkey WHERE annotated GROUP BY 1 ORDER BY n DESC, p_type")
def a20_top_values(v):
    flagged = v.features.where("annotated").select(F.col("feature_id").alias("p_partkey"))
    return A.top_values(v.table("part").join(flagged, "p_partkey"), "p_type")


@register("SELECT feature_id, length, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, CAST(median(cov) AS DOUBLE) AS coverage_median FROM (SELECT c.feature_id, length, cov FROM cov c JOIN features f ON f.feature_id = c.feature_id WHERE sid % 3 <> 0) GROUP BY 1, 2")
def a21_features_from_raw(v):
    f = v.features
    raw = f.select("feature_id", "chrom", "strand", "start", "end", F.transform("samples", lambda s: s["sid"]).alias("sids"), F.transform("samples", lambda s: F.when(s["sid"] % 3 == 0, 0).otherwise(s["cov"])).alias("covs"))
    return A.features_from_raw(raw).select("feature_id", "length", "samples_count", "coverage_sum", "coverage_median")


@register('SELECT chrom, (start - 1) // 1000 AS region_bin, min(start) AS start, max("end") AS "end" FROM features GROUP BY 1, 2')
def a22_chrom_ranges(v):
    return I.chrom_ranges(v.features, 1000)


@register('SELECT chrom, start, "end", string_agg(CAST(x AS VARCHAR), \',\' ORDER BY s) AS row FROM (SELECT b.chrom, b.start, b."end", s.sid AS s, CAST(coalesce(v.value, 0) AS BIGINT) AS x FROM (SELECT DISTINCT chrom, start, "end" FROM bases) b CROSS JOIN (SELECT DISTINCT sid FROM bases) s LEFT JOIN bases v ON v.chrom = b.chrom AND v.start = b.start AND v.sid = s.sid) GROUP BY 1, 2, 3')
def a23_coverage_matrix(v):
    return A.coverage_matrix(v.bases).select("chrom", "start", "end", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("row"))


@register('SELECT chrom, start, "end", string_agg(CAST(x AS VARCHAR), \',\' ORDER BY s) AS row FROM (SELECT b.chrom, b.start, b."end", s.sid AS s, CAST(coalesce(v.value, 0) AS BIGINT) AS x FROM (SELECT DISTINCT chrom, start, "end" FROM bases WHERE sid IN (SELECT user_id FROM events WHERE event_type = \'purchase\' AND value > 100)) b CROSS JOIN (SELECT DISTINCT user_id AS sid FROM events WHERE event_type = \'purchase\' AND value > 100) s LEFT JOIN bases v ON v.chrom = b.chrom AND v.start = b.start AND v.sid = s.sid) GROUP BY 1, 2, 3')
def a23_coverage_matrix_of_samples(v):
    buyers = v.table("events").where("event_type = 'purchase' and value > 100").select("user_id")
    return A.coverage_matrix(v.bases, buyers).select("chrom", "start", "end", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("row"))


_AUC = "(SELECT sid AS a_sid, CASE WHEN sid = 5 THEN 0e0 ELSE CAST(sum(cov) AS DOUBLE) END AS auc FROM cov GROUP BY 1)"
_NORM = f"(SELECT feature_id, sid, cov, CAST(CASE WHEN auc = 0 THEN 0 ELSE round_even(4e3 * cov / auc, 0) END AS BIGINT) AS norm FROM cov JOIN {_AUC} ON a_sid = sid)"


def _auc(v):
    return v.cov.groupBy("sid").agg(F.sum("cov").cast("double").alias("auc")).withColumn("auc", F.when(F.col("sid") == 5, 0.0).otherwise(F.col("auc")))


def _norm(v):
    return A.normalise_auc(v.cov, _auc(v), 4e3)


@register(f"SELECT * FROM {_NORM}")
def n1_normalise_auc(v):
    return _norm(v).select("feature_id", "sid", "cov", "norm")


@register("SELECT feature_id, c.sid, cov, CAST(round_even(cov / CAST(total AS DOUBLE) * (SELECT avg(t) FROM (SELECT sum(cov) AS t FROM cov GROUP BY sid)), 0) AS BIGINT) AS norm FROM cov c JOIN (SELECT sid, sum(cov) AS total FROM cov GROUP BY 1) s ON s.sid = c.sid")
def n2_normalise_jxcov(v):
    return A.normalise_jxcov(v.cov).select("feature_id", "sid", "cov", "norm")


@register(f"SELECT feature_id, count(*) AS samples_count, CAST(sum(norm) AS BIGINT) AS coverage_sum, avg(norm) AS coverage_avg, CAST(median(norm) AS DOUBLE) AS coverage_median FROM {_NORM} WHERE norm > 0 GROUP BY 1")
def n3_restat_nonzero(v):
    return A.restat_nonzero(_norm(v))


@register(f"SELECT feature_id, sid, norm FROM {_NORM} WHERE feature_id IN (SELECT feature_id FROM {_NORM} WHERE norm > 0)")
def n4_skip_zero_rows(v):
    return A.skip_zero_rows(_norm(v)).select("feature_id", "sid", "norm")


@register("SELECT rail_id AS sid, balance AS auc FROM samples WHERE balance > 0")
def n5_eligible_samples(v):
    return A.eligible_samples(v.samples.select(F.col("rail_id").alias("sid"), "balance", (F.col("balance") > 0).alias("has_bases")), "has_bases", "balance")


@register("SELECT feature_id, CAST(feature_id AS VARCHAR) AS by_gene, concat(chrom, ':', start, '-', \"end\") AS by_place FROM features")
def n6_row_key(v):
    return v.features.withColumn("gene_id", F.col("feature_id")).select("feature_id", row_key("gene").alias("by_gene"), row_key("place").alias("by_place"))


@register("SELECT feature_id, row_number() OVER (ORDER BY chrom, start, feature_id) - 1 AS id FROM features")
def w1_assign_ids(v):
    return I.dense_ids(v.features.select("feature_id", "chrom", "start"), ["feature_id"], width=1000).select("feature_id", "id")


@register('SELECT chrom, reach AS gap_start, start AS gap_end, start - reach + 1 AS gap FROM (SELECT chrom, start, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons) WHERE start > reach')
def w2_gaps(v):
    return I.gaps(v.exons, width=1000).orderBy(F.desc("gap"), "chrom", "gap_start")


@register("SELECT i AS id FROM (SELECT unnest(range(min(doc_id), max(doc_id))) AS i FROM labels) WHERE i NOT IN (SELECT doc_id FROM labels)")
def w3_missing_ids(v):
    return I.missing_ids(v.table("labels"), "doc_id")


@register("""SELECT chrom, min(start) AS start, arg_max("end", start) AS "end", any_value(value) AS value, count(*) AS n_rows FROM (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY chrom ORDER BY start) THEN 0 ELSE 1 END AS c FROM depth)) GROUP BY chrom, run""")
def w4_collapse_ranges(v):
    return I.collapse_ranges(v.depth, "value", width=50)


@register("SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS p FROM lineitem) WHERE l_shipdate < p")
def w5_unsorted_rows(v):
    return I.unsorted_rows(v.table("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate")


@register("SELECT chrom, strand, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand ORDER BY samples_count DESC, feature_id) AS k FROM features) WHERE k = 1")
def w6_top_flank(v):
    return X.top_flank(v.features, ["chrom", "strand"], [F.desc("samples_count"), F.col("feature_id")]).select("chrom", "strand", "feature_id")


@register('SELECT chrom, feature_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY length, feature_id) AS k FROM features WHERE len(right_sources) > 0) WHERE k = 1')
def w7_shortest_annotated(v):
    return X.shortest_annotated(v.features, ["chrom"], F.size("right_sources") > 0, ["feature_id", "start", "end"])


@register("SELECT feature_id, samples_count, coverage_sum FROM features WHERE NOT annotated AND length <= 400 ORDER BY samples_count DESC, coverage_sum DESC, feature_id LIMIT 25")
def w8_top_novel(v):
    return X.top_novel(v.features, 400, 25).select("feature_id", "samples_count", "coverage_sum")


@register("SELECT chrom, strand, count(*) AS n, CAST(sum(coverage_sum) AS BIGINT) AS total FROM features GROUP BY 1, 2 ORDER BY n DESC, total DESC, chrom, strand")
def w9_report(v):
    return A.report(v.features, ["chrom", "strand"], {"n": F.count("*"), "total": F.sum("coverage_sum")})


@register("SELECT feature_id, coverage_sum FROM features ORDER BY coverage_sum, feature_id")
def w10_sorted_by(v):
    return X.sorted_by(v.features.select("feature_id", "coverage_sum"), "coverage_sum", "feature_id")


@register("SELECT feature_id, string_agg(study, ',' ORDER BY n DESC, c DESC, study) AS studies FROM (SELECT feature_id, study, count(*) AS n, sum(cov) AS c FROM cov JOIN samples ON rail_id = sid GROUP BY 1, 2) GROUP BY 1")
def w11_inner_sort(v):
    ordered = A.studies_in_order(v.cov, v.samples.select(F.col("rail_id").alias("sid"), "study"))
    return ordered.select("feature_id", F.array_join("studies", ",").alias("studies"))
