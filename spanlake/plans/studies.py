"""Flanking junctions, tissues, group comparison, and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import flank as X
from spanlake.operators import quality as Q
from spanlake.plans.register import Register

register = Register()


def _lists(v):
    """Pairs with both sides' sample lists."""
    lists = v.features.select("feature_id", "samples")
    return v.pairs.join(lists.select(F.col("feature_id").alias("left_id"), F.col("samples").alias("left")), "left_id").join(lists.select(F.col("feature_id").alias("right_id"), F.col("samples").alias("right")), "right_id")


_BOTH = "(SELECT p.pair, l.sid, l.cov AS lc, r.cov AS rc FROM pairs p JOIN cov l ON l.feature_id = p.left_id JOIN cov r ON r.feature_id = p.right_id AND r.sid = l.sid)"


@register(f"""WITH s AS (SELECT pair, count(*) AS n, CAST(sum(lc) AS BIGINT) AS lsum, CAST(sum(rc) AS BIGINT) AS rsum, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid) AS shared FROM {_BOTH} GROUP BY 1),
m AS (SELECT pair, median(lc + rc) AS med FROM {_BOTH} GROUP BY 1)
SELECT p.pair, coalesce(n, 0) AS n_shared, coalesce(shared, '') AS shared, coalesce(coalesce(n, 0) / CAST(nullif(l.samples_count, 0) AS DOUBLE), 0e0) AS left_ratio, coalesce(coalesce(n, 0) / CAST(nullif(r.samples_count, 0) AS DOUBLE), 0e0) AS right_ratio, coalesce(lsum + rsum, 0) AS shared_sum, coalesce(lsum, 0) AS left_sum, coalesce(rsum, 0) AS right_sum,
coalesce((lsum + rsum) / CAST(n AS DOUBLE), -1e0) AS shared_avg, coalesce(CAST(med AS DOUBLE), -1e0) AS shared_median, l.samples_count - coalesce(n, 0) AS n_left_only, r.samples_count - coalesce(n, 0) AS n_right_only
FROM pairs p JOIN features l ON l.feature_id = left_id JOIN features r ON r.feature_id = right_id LEFT JOIN s ON s.pair = p.pair LEFT JOIN m ON m.pair = p.pair""")
def x1_shared_samples(v):
    out = X.shared_samples(_lists(v))
    return out.select("pair", "n_shared", F.array_join(F.transform("shared", lambda s: s.cast("string")), ",").alias("shared"), "left_ratio", "right_ratio", "shared_sum", "left_sum", "right_sum", "shared_avg", "shared_median", F.size("left_only").cast("long").alias("n_left_only"), F.size("right_only").cast("long").alias("n_right_only"))


_FLANK = "(SELECT chrom AS gene, strand, sid, sum(cov) AS c FROM cov k JOIN features f ON f.feature_id = k.feature_id GROUP BY 1, 2, 3)"


@register(f"SELECT l.gene, count(*) AS n_shared, CAST(sum(l.c * r.c) AS BIGINT) AS products, CAST(sum(least(l.c, r.c)) AS BIGINT) AS minima, avg(l.c * r.c) AS mean, CAST(median(CAST(l.c * r.c AS BIGINT)) AS DOUBLE) AS median FROM {_FLANK} l JOIN {_FLANK} r ON l.gene = r.gene AND l.sid = r.sid AND l.strand = '+' AND r.strand = '-' GROUP BY 1")
def x2_all_shared(v):
    own = v.cov.join(v.features.select("feature_id", F.col("chrom").alias("gene"), "strand"), "feature_id")
    return X.all_shared(own.where("strand = '+'"), own.where("strand = '-'"))


@register("SELECT pair, left_end - left_start + 1 AS left_intron, right_end - right_start + 1 AS right_intron, right_start - left_end - 1 AS exon, left_annotated AND right_annotated AS both_annotated FROM pairs")
def x3_flank_geometry(v):
    return X.flank_geometry(v.pairs).select("pair", "left_intron", "right_intron", "exon", "both_annotated")


@register("""SELECT feature_id, tissue, n, CAST(coverage AS BIGINT) AS coverage, n / CAST(sum(n) OVER w AS DOUBLE) AS ratio, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY n DESC, tissue) AS INTEGER) AS rank, count(*) OVER w AS n_tissues, max(n) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS max_ratio
FROM (SELECT feature_id, tissue, count(*) AS n, sum(cov) AS coverage FROM cov JOIN samples ON rail_id = sid GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature_id)""")
def x4_tissue_breakdown(v):
    return X.tissue_breakdown(v.cov, v.samples.select(F.col("rail_id").alias("sid"), "tissue"))


@register("SELECT p_partkey AS feature_id, coalesce(avg(cov), -1e0) AS mean, coalesce(CAST(median(cov) AS DOUBLE), -1e0) AS median FROM part LEFT JOIN (SELECT * FROM cov WHERE cov > 40) c ON feature_id = p_partkey GROUP BY 1")
def x5_avg_median(v):
    return X.avg_median(v.cov.where("cov > 40"), v.table("part").select(F.col("p_partkey").alias("feature_id")), "feature_id", "cov")


@register(f"""WITH s AS (SELECT * FROM pairs WHERE pair IN (SELECT pair FROM {_BOTH})) SELECT pair, chrom, 'B' AS "group", left_start AS start, left_end AS "end" FROM s UNION ALL SELECT pair, chrom, 'B', right_start, right_end FROM s UNION ALL SELECT pair, chrom, 'A', left_start, right_end FROM s""")
def x6_inclusion_queries(v):
    return X.inclusion_queries(_lists(v))


@register("SELECT gene, count(DISTINCT strand) AS n_strands FROM tx_exons GROUP BY 1 HAVING count(DISTINCT strand) > 1")
def x7_mixed_strands(v):
    return X.mixed_strands(v.tx_exons)


_RANKED = "(SELECT feature_id, list(CASE WHEN tissue = 'NATION_3' THEN '?' ELSE tissue END ORDER BY n DESC, tissue) AS t FROM (SELECT feature_id, tissue, count(*) AS n FROM cov JOIN samples ON rail_id = sid GROUP BY 1, 2) GROUP BY 1)"


@register(f"""WITH l AS (SELECT p.pair, list_filter(x.t, lambda k: k <> '?') AS a, list_filter(y.t, lambda k: k <> '?') AS b FROM pairs p JOIN {_RANKED} x ON x.feature_id = left_id JOIN {_RANKED} y ON y.feature_id = right_id),
r AS (SELECT *, least(5, len(a), len(b)) AS x FROM l)
SELECT pair, coalesce(len(list_filter(range(1, x + 1), lambda i: a[i] = b[i])) / CAST(nullif(x, 0) AS DOUBLE), 0e0) AS place_rate,
coalesce(len(list_intersect(a[1:x], b[1:x])) / CAST(nullif(x, 0) AS DOUBLE), 0e0) AS top_overlap, coalesce(len(list_intersect(a, b)) / CAST(nullif(len(a), 0) AS DOUBLE), 0e0) AS overlap,
coalesce(a[1] = b[1], false) AS first_match, len(a) >= 2 AND len(b) >= 2 AND (a[1] = b[2] OR a[2] = b[1]) AS first_in_two FROM r""")
def x8_compare_ranked(v):
    t = X.tissue_breakdown(v.cov, v.samples.select(F.col("rail_id").alias("sid"), "tissue"))
    lists = t.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.when(F.col("tissue") == "NATION_3", "?").otherwise(F.col("tissue")).alias("t")))).alias("l")).select("feature_id", F.transform("l", lambda x: x["t"]).alias("l"))
    both = v.pairs.select("pair", "left_id", "right_id").join(lists.select(F.col("feature_id").alias("left_id"), F.col("l").alias("a")), "left_id").join(lists.select(F.col("feature_id").alias("right_id"), F.col("l").alias("b")), "right_id")
    return X.compare_ranked(both).drop("left_id", "right_id", "a", "b")


_TAIL = "(1 / (1 + 2.316419e-1 * abs(z)))"


@register(f"""WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality AS g FROM texts WHERE quality IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS k FROM t),
s AS (SELECT CAST(count(*) FILTER (g = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 0) AS DOUBLE) AS n0, sum(k) FILTER (g = 1) AS ranks FROM r), e AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*) AS c FROM t GROUP BY v)),
w AS (SELECT n1, n0, ranks - n1 * (n1 + 1) / 2 AS w, ties, n1 + n0 AS n FROM s, e), z AS (SELECT n1, n0, w, (w - n1 * n0 / 2 - 5e-1) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM w),
p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * {_TAIL} * (3.1938153e-1 + {_TAIL} * (-3.56563782e-1 + {_TAIL} * (1.781477937e0 + {_TAIL} * (-1.821255978e0 + {_TAIL} * 1.330274429e0)))) AS q FROM z)
SELECT n1, n0, w, round(z, 9) AS z, round(CASE WHEN z >= 0 THEN q ELSE 1 - q END, 9) AS p FROM p""")
def x9_rank_sum(v):
    return X.rank_sum(v.texts.where("quality is not null"), "n_chars", "quality").withColumns({c: F.round(c, 9) for c in ("z", "p")})


@register("SELECT feature_id FROM features WHERE NOT (start BETWEEN 100 AND 9000 AND start <= \"end\" - 150) OR (annotated AND strand = '-')")
def q1_check_spans(v):
    spans = F.array(F.struct(F.lit(100).cast("long").alias("start"), F.lit(9000).cast("long").alias("end")), F.struct(F.lit(0).cast("long").alias("start"), (F.col("end") - 150).alias("end")))
    own = v.features.withColumns({"spans": spans, "strands": F.array(F.lit("+")), "sense": F.col("annotated")})
    return Q.check_spans(own, "start", "spans").select("feature_id")


@register("SELECT feature_id FROM features WHERE feature_id % 97 IN (0, 1, 2)")
def q2_check_lists(v):
    k = F.col("feature_id") % 97
    text = F.when(k == 0, ",1,2").when(k == 1, "1,,2").when(k == 2, "1,2,").otherwise("1,2")
    return Q.check_lists(v.features.select("feature_id", text.alias("l")), "l").select("feature_id")


@register("SELECT DISTINCT sid, 'used' AS side FROM cov WHERE sid % 7 = 0 UNION ALL SELECT rail_id, 'known' FROM samples WHERE rail_id % 5 = 0 AND rail_id % 7 <> 0")
def q3_reconcile_ids(v):
    return Q.reconcile_ids(v.cov.where("sid % 5 <> 0 or sid % 7 = 0"), v.samples.select(F.col("rail_id").alias("sid")).where("sid % 7 <> 0"))


@register("SELECT p_type, p_size % 5 AS s, side FROM (SELECT p_type, p_size, CASE WHEN p_partkey % 97 = 0 THEN 'first' ELSE 'second' END AS side FROM part WHERE p_partkey % 97 < 2 AND FALSE) UNION ALL SELECT 'x', 1, 'first' UNION ALL SELECT 'x', 1, 'first' UNION ALL SELECT 'y', 2, 'second'")
def q4_diff(v):
    own = v.table("part").select("p_type", (F.col("p_size") % 5).alias("s"))
    more = v.spark.createDataFrame([("x", 1), ("x", 1)], "p_type string, s int")
    other = v.spark.createDataFrame([("y", 2)], "p_type string, s int")
    return Q.diff(own.unionByName(more), own.unionByName(other))


@register("""WITH e AS (SELECT l_orderkey % 50 AS part, arg_min(l_suppkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)) AS first, arg_max(l_suppkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)) AS last FROM lineitem GROUP BY 1) SELECT DISTINCT a.first AS l_suppkey FROM e a JOIN e b ON a.first = b.last AND a.part <> b.part""")
def q5_split_groups(v):
    t = v.table("lineitem").select((F.col("l_orderkey") % 50).alias("part"), "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return Q.split_groups(t, "part", "o", "l_suppkey")


@register("SELECT feature_id, cov AS expected, CASE WHEN feature_id % 97 = 0 THEN 0 ELSE cov + 1 END AS found FROM cov WHERE sid = 7 AND (feature_id % 97 = 0 OR feature_id % 89 = 0)")
def q6_reconcile_sums(v):
    own = v.cov.where("sid = 7").select("feature_id", F.col("cov").alias("value"))
    bases = own.where("feature_id % 97 <> 0").withColumn("value", F.col("value") + F.when(F.col("feature_id") % 89 == 0, 1).otherwise(0))
    return Q.reconcile_sums(own, bases, "feature_id")


@register("SELECT count(DISTINCT tx) AS n_before, count(DISTINCT CASE WHEN tx % 97 = 0 THEN -1 ELSE tx END) AS n_after, count(*) FILTER (tx % 97 = 0) AS n_sentinel FROM tx_exons")
def q7_check_transcripts(v):
    return Q.check_transcripts(v.tx_exons, v.tx_exons.withColumn("tx", F.when(F.col("tx") % 97 == 0, -1).otherwise(F.col("tx"))), "tx")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q8_unmatched(v):
    return Q.unmatched(v.table("orders").select("o_orderkey", "o_custkey"), v.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@register("SELECT event_type, count(*) + 1 AS expected, count(*) AS found FROM events WHERE event_type IN ('click', 'error') GROUP BY 1 UNION ALL SELECT 'nothing', 5, 0")
def q9_check_counts(v):
    e = v.table("events")
    expected = e.groupBy("event_type").agg((F.count("*") + F.when(F.col("event_type").isin("click", "error"), 1).otherwise(0)).alias("expected"))
    return Q.check_counts(e, expected.unionByName(v.spark.createDataFrame([("nothing", 5)], "event_type string, expected long")), "event_type")


@register("SELECT 'l_discount' AS ratio, count(*) FILTER (l_discount * 10 >= 5e-1) AS n_high, count(*) FILTER (l_discount * 10 < 5e-1) AS n_low FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax * 10 >= 5e-1), count(*) FILTER (l_tax * 10 < 5e-1) FROM lineitem")
def q10_fraction_split(v):
    return Q.fraction_split(v.table("lineitem").select((F.col("l_discount") * 10).alias("l_discount"), (F.col("l_tax") * 10).alias("l_tax")), ["l_discount", "l_tax"])
