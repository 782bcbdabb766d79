"""Region, range, annotation and id predicates; projections; bulk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import add_chr, normalise_strand, strip_chr
from spanlake.operators import intervals as I
from spanlake.operators import predicates as P
from spanlake.operators import stats as A
from spanlake.operators.samples import long
from spanlake.plans.register import Register

register = Register()

REGION = ("Brand#7", 3000, 5000)
_PLACE = 'feature_id, chrom, start, "end"'
_IN = "chrom = 'Brand#7' AND \"end\" >= 3000 AND start <= 5000"
_COLUMNS = ["feature_id", "chrom", "start", "end"]


@register(f"SELECT {_PLACE} FROM features WHERE {_IN}")
def f1_overlap(v):
    return P.overlaps(v.features, *REGION).select(_COLUMNS)


@register(f'SELECT {_PLACE} FROM features WHERE {_IN} AND start >= 3000 AND "end" <= 5000')
def f2_contained(v):
    return P.overlaps(v.features, *REGION, contains=True).select(_COLUMNS)


@register("SELECT f.feature_id, f.chrom, f.start, f.\"end\" FROM features f, (SELECT chrom, start, \"end\" FROM features WHERE feature_id = 1) x WHERE f.chrom = x.chrom AND f.start = x.start AND f.\"end\" = x.\"end\"")
def f3_exact(v):
    one = v.features.where("feature_id = 1").select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.lit("exact").alias("mode"))
    return P.in_regions(v.features, one, "mode").select(_COLUMNS)


@register(f"SELECT {_PLACE} FROM features WHERE {_IN} AND start >= 3000")
def f4_start_within(v):
    return P.overlaps(v.features, *REGION, either="start").select(_COLUMNS)


@register(f'SELECT {_PLACE} FROM features WHERE {_IN} AND "end" <= 5000')
def f5_end_within(v):
    return P.overlaps(v.features, *REGION, either="end").select(_COLUMNS)


_MODE = """CASE mode WHEN 'contains' THEN start >= b_start AND "end" <= b_end WHEN 'exact' THEN start = b_start AND "end" = b_end WHEN 'start' THEN start >= b_start WHEN 'end' THEN "end" <= b_end ELSE true END"""
_JOIN = 'features JOIN regions ON chrom = b_chrom AND "end" >= b_start AND start <= b_end'


@register("SELECT feature_id, chrom, start, \"end\" FROM features f JOIN (VALUES ('Brand#7', 3000, 5000), ('Brand#7', 4000, 6000), ('Brand#9', 1, 800)) r(c, s, e) ON chrom = c AND \"end\" >= s AND start <= e")
def f6_multi_region_bag(v):
    regions = v.spark.createDataFrame([("Brand#7", 3000, 5000), ("Brand#7", 4000, 6000), ("Brand#9", 1, 800)], "b_chrom string, b_start long, b_end long")
    return P.in_regions(v.features, regions).select(_COLUMNS)


@register(f"SELECT DISTINCT feature_id, chrom, start, \"end\" FROM {_JOIN} WHERE {_MODE}")
def f6_regions_distinct(v):
    return P.in_regions(v.features.select(_COLUMNS), v.regions, "mode", distinct="feature_id")


@register("SELECT feature_id, samples_count, coverage_avg FROM features WHERE samples_count >= 20 AND length < 600 AND coverage_avg > 25 AND coverage_sum <> 700 AND coverage_median <= 30")
def f7_range_filters(v):
    df = v.features
    for column, op, value in (("samples_count", ">=", 20), ("length", "<", 600), ("coverage_avg", ">", 25), ("coverage_sum", "!=", 700), ("coverage_median", "<=", 30)):
        df = P.where_stat(df, column, op, value)
    return df.select("feature_id", "samples_count", "coverage_avg")


@register("SELECT feature_id FROM features WHERE annotated AND len(left_sources) > 0 AND NOT len(right_sources) > 0")
def f8_annotated(v):
    df = P.where_annotated(v.features, "both", True)
    return P.where_annotated(P.where_annotated(df, "left", True), "right", False).select("feature_id")


@register("SELECT feature_id, strand FROM features WHERE strand = '-'")
def f9_strand(v):
    return P.where_strand(v.features, "-").select("feature_id", "strand")


@register("SELECT feature_id, coverage_sum FROM features JOIN part ON p_partkey = feature_id WHERE p_type = 'ECONOMY' ORDER BY 1")
def f10_by_ids(v):
    ids = v.table("part").where("p_type = 'ECONOMY'").select("p_partkey")
    return P.by_ids(v.features, ids).select("feature_id", "coverage_sum")


@register(f"SELECT feature_id FROM features WHERE {_IN} AND feature_id IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def f11_region_and_ids(v):
    ids = v.table("part").where("p_type = 'ECONOMY'").select("p_partkey")
    return P.by_ids(P.overlaps(v.features, *REGION), ids).select("feature_id")


_KEPT = "(SELECT feature_id, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, avg(cov) AS coverage_avg, CAST(median(cov) AS DOUBLE) AS coverage_median, string_agg(concat(',', sid, ':', cov), '' ORDER BY sid) AS list FROM cov WHERE sid IN (SELECT rail_id FROM samples WHERE study = 'ASIA') GROUP BY 1)"


@register(f"SELECT f.feature_id, k.samples_count, k.coverage_sum FROM features f JOIN {_KEPT} k ON f.feature_id = k.feature_id WHERE f.strand = '+' AND f.annotated AND k.samples_count >= 3 AND f.chrom = 'Brand#7' AND f.\"end\" >= 100 AND f.start <= 9000")
def f12_all_families(v):
    sids = v.samples.where("study = 'ASIA'").select("rail_id")
    return P.query(v.features, ("Brand#7", 100, 9000), stats=[("samples_count", ">=", 3)], sids=sids, annotated={"both": True}, strand="+", fields=["feature_id", "samples_count", "coverage_sum"])


@register("SELECT feature_id, length, strand FROM features WHERE coverage_sum >= 500")
def f13_projection(v):
    return P.query(v.features, stats=[("coverage_sum", ">=", 500)], fields=["feature_id", "length", "strand"])


@register('SELECT chrom, start, "end", ' + ", ".join(f"coalesce(max(value) FILTER (sid = {s}), 0e0) AS s{s}" for s in range(10)) + ' FROM bases WHERE sid < 10 GROUP BY ALL')
def f14_base_columns(v):
    return A.base_columns(v.bases, list(range(10)))


@register('SELECT chrom, start, "end", ' + ", ".join(f"coalesce(max(value) FILTER (sid = {s}), 0e0) AS {g}_s{s}" for g, s in (("a", 1), ("a", 4), ("b", 4), ("b", 12))) + " FROM bases WHERE sid IN (1, 4, 12) GROUP BY ALL")
def f14_base_columns_of_groups(v):
    return A.base_columns(v.bases, groups={"a": [1, 4], "b": [4, 12]})


_HOURS = "chrom = 'click' AND \"end\" >= (SELECT min(\"end\") + 100 FROM bases) AND start < (SELECT min(\"end\") + 400 FROM bases)"


def _hours(v):
    first = v.bases.agg(F.min("end")).first()[0] or 0  # the region's place, one number
    return ("click", first + 100, first + 400)


@register(f'SELECT chrom, start, "end", sid, value FROM bases WHERE {_HOURS} AND sid IN (SELECT user_id FROM events WHERE event_type = \'purchase\' AND value > 100)')
def f14_base_region(v):
    buyers = v.table("events").where("event_type = 'purchase' and value > 100").select("user_id")
    return A.base_query(v.bases, _hours(v), buyers)


@register(f'SELECT chrom, start, "end", sum(value) / (SELECT count(DISTINCT sid) FROM bases) AS value, \'hours\' AS label FROM bases WHERE {_HOURS} GROUP BY 1, 2, 3')
def f14_base_region_mean(v):
    return A.base_query(v.bases, _hours(v), v.bases.select("sid"), "mean", label="hours")


@register(f"SELECT 'hours' AS label, sid, sum(value) AS value FROM bases WHERE {_HOURS} GROUP BY sid")
def f14_base_region_by_sample(v):
    return A.base_query(v.bases, _hours(v), None, "sum", "sample", "hours")


_SPLITS = f"""(SELECT b.*, concat('click|', greatest(lo, k * 100 + 1), '|', least(hi, (k + 1) * 100), '|hours') AS label FROM (SELECT *, unnest(range((lo - 1) // 100, (hi - 1) // 100 + 1)) AS k FROM (SELECT min("end") + 100 AS lo, min("end") + 400 AS hi FROM bases)) s
JOIN bases b ON b.chrom = 'click' AND b."end" >= greatest(lo, k * 100 + 1) AND b.start < least(hi, (k + 1) * 100))"""


@register(f'SELECT label, chrom, start, "end", sum(value) AS value FROM {_SPLITS} GROUP BY 1, 2, 3, 4')
def f14_base_region_by_splits(v):
    return A.base_query_by_splits(v.bases, _hours(v), 100, label="hours")


@register(f'WITH s AS (SELECT * FROM {_SPLITS}), n AS (SELECT label, count(DISTINCT (start, "end")) AS n FROM s GROUP BY 1) SELECT s.label, sid, sum(value) / any_value(n) AS value FROM s JOIN n ON n.label = s.label GROUP BY 1, 2')
def f14_base_samples_by_splits(v):
    return A.base_query_by_splits(v.bases, _hours(v), 100, "mean", "sample", "hours")


@register(f"SELECT count(DISTINCT feature_id) AS n_ids FROM {_JOIN} WHERE {_MODE}")
def f15_count_ids(v):
    return P.count_ids(P.in_regions(v.features.select(_COLUMNS), v.regions, "mode", distinct="feature_id"))


_NAMED = "SELECT feature_id, CASE WHEN feature_id % 6 = 0 THEN concat('chrUn', feature_id) WHEN feature_id % 6 = 1 THEN 'chrX' WHEN feature_id % 6 = 2 THEN 'chrM' ELSE concat('chr', feature_id % 23) END AS chrom FROM features"


def _named(v):
    k = F.col("feature_id")
    return v.features.select("feature_id", F.when(k % 6 == 0, F.concat(F.lit("chrUn"), k.cast("string"))).when(k % 6 == 1, "chrX").when(k % 6 == 2, "chrM").otherwise(F.concat(F.lit("chr"), (k % 23).cast("string"))).alias("chrom"))


@register(f"SELECT * FROM ({_NAMED}) WHERE regexp_full_match(chrom, 'chr([0-9]{{1,2}}|X|Y|M)')")
def f16_standard_chroms(v):
    return P.standard_chroms(_named(v))


@register("SELECT label, label % 7 <> 0 AND label % 11 <> 0 AS valid FROM regions")
def f17_valid_regions(v):
    k = F.col("label")
    text = v.regions.select("label", F.when(k % 11 == 0, "12x").when(k % 7 == 0, F.col("b_end").cast("string")).otherwise(F.col("b_start").cast("string")).alias("start"), F.when(k % 7 == 0, F.col("b_start").cast("string")).otherwise(F.col("b_end").cast("string")).alias("end"))
    return text.select("label", P.valid_regions(text).alias("valid"))


@register("SELECT feature_id, CASE WHEN feature_id % 5 = 0 THEN '*' ELSE strand END AS strand FROM features")
def f18_normalise_strand(v):
    unknown = v.features.select("feature_id", F.when(F.col("feature_id") % 5 == 0, "?").otherwise(F.col("strand")).alias("strand"))
    return unknown.select("feature_id", normalise_strand("strand").alias("strand"))


@register("SELECT feature_id, 'novel' AS kind FROM features WHERE NOT annotated UNION ALL SELECT feature_id, 'known' FROM features WHERE annotated UNION ALL SELECT feature_id, 'both' FROM features")
def f19_known_novel(v):
    return P.any_of([P.split_annotated(v.features.select("feature_id", "annotated"), k).select("feature_id", F.lit(k).alias("kind")) for k in ("known", "novel", "both")])


@register("SELECT label, b AS region_bin, greatest(b_start, b * 1000 + 1) AS clip_start, least(b_end, (b + 1) * 1000) AS clip_end FROM (SELECT *, unnest(range((b_start - 1) // 1000, (b_end - 1) // 1000 + 1)) AS b FROM regions)")
def f20_clip_to_bins(v):
    r = v.regions.select("label", F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    return I.clip_to_bins(r, 1000).select("label", "region_bin", "clip_start", "clip_end")


@register("SELECT feature_id, concat('chr', chrom) AS added, chrom AS stripped FROM features")
def f21_chrom_prefix(v):
    both = v.features.select("feature_id", add_chr("chrom").alias("added"))
    return both.select("feature_id", add_chr("added").alias("added"), strip_chr("added").alias("stripped"))


@register(f"SELECT feature_id, list AS samples, samples_count, coverage_sum, coverage_avg, coverage_median FROM {_KEPT}")
def m1_restrict_samples(v):
    from spanlake.functions import encode_samples

    sids = v.samples.where("study = 'ASIA'").select("rail_id")
    return P.restrict_samples(v.features.select("feature_id", "samples"), sids).withColumn("samples", encode_samples("samples"))


@register(f"SELECT feature_id, samples_count, coverage_sum, coverage_avg, coverage_median FROM {_KEPT} WHERE samples_count > 2 AND coverage_avg >= 25 AND coverage_median < 40")
def m2_restrict_then_filter(v):
    sids = v.samples.where("study = 'ASIA'").select("rail_id")
    out = P.query(v.features, stats=[("samples_count", ">", 2), ("coverage_avg", ">=", 25), ("coverage_median", "<", 40)], sids=sids)
    return out.select("feature_id", "samples_count", "coverage_sum", "coverage_avg", "coverage_median")


@register(f"SELECT feature_id, samples_count, coverage_sum FROM {_KEPT}")
def m18_restrict_basic(v):
    sids = v.samples.where("study = 'ASIA'").select("rail_id")
    return P.restrict_samples(v.features.select("feature_id", "samples"), sids, stats="basic").drop("samples")


@register(f"SELECT label, feature_id, samples_count, coverage_sum FROM {_JOIN} WHERE {_MODE} AND (label % 2 = 0 OR samples_count >= 20) AND (label % 3 <> 0 OR strand = '+')")
def b1_bulk_query(v):
    k = F.col("label")
    asked = v.regions.withColumns({"min_samples_count": F.when(k % 2 != 0, 20), "strand_wanted": F.when(k % 3 == 0, "+")})
    return P.bulk_query(v.features, asked).select("label", "feature_id", "samples_count", "coverage_sum")


@register(f"""SELECT label, feature_id, samples_count, coverage_sum FROM {_JOIN} WHERE {_MODE} AND (label % 2 = 0 OR annotated = (label % 3 = 0)) AND (label % 5 <> 1 OR len(right_sources) > 0)
AND (label % 4 <> 1 OR (length < 800 AND coverage_avg > 24.5)) AND (label % 4 <> 2 OR (coverage_sum <> 700 AND samples_count >= 25 AND coverage_median <= 30))""")
def b1_bulk_filters(v):
    k = F.col("label")
    one = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(float(value)).alias("value"))
    filters = F.when(k % 4 == 1, F.array(one("length", "<", 800), one("coverage_avg", ">", 24.5))).when(k % 4 == 2, F.array(one("coverage_sum", "!=", 700), one("samples_count", ">=", 25), one("coverage_median", "<=", 30)))
    asked = v.regions.withColumns({"filters": filters, "annotated_wanted": F.when(k % 2 != 0, k % 3 == 0), "right_wanted": F.when(k % 5 == 1, True)})
    return P.bulk_query(v.features, asked).select("label", "feature_id", "samples_count", "coverage_sum")


@register("""SELECT q.label, f.feature_id, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, avg(cov) AS coverage_avg FROM (SELECT * FROM regions WHERE mode = 'overlap') q JOIN features f ON f.chrom = b_chrom AND f."end" >= b_start AND f.start <= b_end
JOIN cov c ON c.feature_id = f.feature_id JOIN samples s ON s.rail_id = c.sid AND ascii(right(s.tissue, 1)) % 3 = (q.label // 5) % 3 GROUP BY 1, 2""")
def b1_bulk_with_samples(v):
    lists = v.samples.select((F.ascii(F.expr("right(tissue, 1)")) % 3).cast("long").alias("list"), F.col("rail_id").alias("sid"))
    asked = v.regions.where("mode = 'overlap'").drop("mode").withColumn("list", F.floor(F.col("label") / 5) % 3)
    return P.bulk_query(v.features, asked, lists=lists).select("label", "feature_id", "samples_count", "coverage_sum", "coverage_avg")


@register(f"SELECT feature_id FROM features WHERE {_IN} UNION ALL SELECT feature_id FROM features WHERE strand = '+' AND samples_count >= 25")
def b2_any_of(v):
    return P.any_of([P.query(v.features, REGION, fields=["feature_id"]), P.query(v.features, stats=[("samples_count", ">=", 25)], strand="+", fields=["feature_id"])])


@register("SELECT feature_id, sid, cov, concat('s', sid % 3) AS split, CASE WHEN sid % 3 = 0 THEN cov * 2 END AS doubled FROM cov")
def b3_union_splits(v):
    splits = {f"s{k}": v.cov.where(F.col("sid") % 3 == k).select("feature_id", "sid", "cov") for k in range(3)}
    return P.union_splits(splits | {"s0": splits["s0"].withColumn("doubled", F.col("cov") * 2)})


@register("SELECT feature_id, sid, cov FROM cov")
def d1_long_form(v):
    return long(v.features)
