"""Stand-ins for the engine's tables, derived from the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import summary
from spanlake.operators.samples import ROWS, dealt

#: Views by name, each an SQL query that may use earlier ones.
SQL = {
    "cov": "SELECT l_partkey AS feature_id, l_suppkey AS sid, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cov FROM lineitem GROUP BY 1, 2",
    "lists": "SELECT feature_id, list(struct_pack(sid := sid, cov := cov) ORDER BY sid) AS samples, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum, avg(cov) AS coverage_avg, CAST(median(cov) AS DOUBLE) AS coverage_median FROM cov GROUP BY 1",
    "features": """SELECT p_partkey AS feature_id, p_brand AS chrom, (p_partkey * 37) % 10000 + 1 AS start, (p_partkey * 37) % 10000 + p_size * 20 AS "end", CAST(p_size * 20 AS BIGINT) AS length,
 CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey % 4 <> 0 AS annotated,
 CASE p_partkey % 3 WHEN 0 THEN 'CT' ELSE 'GT' END AS left_motif, CASE p_partkey % 3 WHEN 0 THEN 'AC' ELSE 'AG' END AS right_motif,
 CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [p_type] ELSE list_sort([p_type, 'M']) END AS left_sources, CASE p_partkey % 5 WHEN 0 THEN [] ELSE [p_type] END AS right_sources,
 coalesce(samples, []) AS samples, coalesce(samples_count, 0) AS samples_count, coalesce(coverage_sum, 0) AS coverage_sum, coalesce(coverage_avg, 0e0) AS coverage_avg, coalesce(coverage_median, 0e0) AS coverage_median
 FROM part LEFT JOIN lists ON p_partkey = feature_id""",
    "samples": "SELECT s_suppkey AS rail_id, s_name AS accession, s_acctbal AS balance, n_name AS tissue, r_name AS study FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "regions": """SELECT c_custkey AS label, concat('Brand#', 1 + c_custkey % 25) AS b_chrom, (c_custkey * 53) % 10000 + 1 AS b_start, (c_custkey * 53) % 10000 + 1 + 100 * (c_nationkey + 1) AS b_end,
 CASE c_custkey % 5 WHEN 0 THEN 'overlap' WHEN 1 THEN 'contains' WHEN 2 THEN 'exact' WHEN 3 THEN 'start' ELSE 'end' END AS mode FROM customer""",
    "exons": """SELECT o_orderkey AS exon, o_custkey AS tx, concat('Brand#', 1 + o_custkey % 25) AS chrom, (o_orderkey * 7) % 10000 + 1 AS start, (o_orderkey * 7) % 10000 + 1 + o_orderkey % 25 AS "end",
 o_orderstatus AS source, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders WHERE o_orderkey % 3 <> 0""",
    "repeats": """SELECT o_orderkey AS rep, concat('Brand#', 1 + o_custkey % 25) AS chrom, (o_orderkey * 11) % 10000 + 1 AS start, (o_orderkey * 11) % 10000 + 1 + o_orderkey % 60 AS "end",
 o_orderpriority AS class, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders WHERE o_orderkey % 3 = 0""",
    "tx_exons": """SELECT l_partkey AS tx, l_partkey // 2 AS gene, concat('Brand#', 1 + l_partkey % 25) AS chrom, (l_partkey % 400) * 20 + (l_suppkey * 13 + l_linenumber * 29) % 1500 + 1 AS start,
 (l_partkey % 400) * 20 + (l_suppkey * 13 + l_linenumber * 29) % 1500 + 1 + CAST(l_quantity AS BIGINT) AS "end", l_returnflag AS source, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem""",
    "bases": """SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS start, CAST(floor(epoch(ts)) AS BIGINT) // 3600 + 1 AS "end", user_id AS sid, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3, 4""",
    "depth": """SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS start, CAST(floor(epoch(ts)) AS BIGINT) // 3600 + 1 AS "end", count(*) AS value FROM events GROUP BY 1, 2, 3""",
    "texts": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "pairs": """SELECT a.feature_id AS pair, a.chrom, a.start AS left_start, a."end" AS left_end, b.start AS right_start, b."end" AS right_end, a.annotated AS left_annotated, b.annotated AS right_annotated, a.feature_id AS left_id, b.feature_id AS right_id
 FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, feature_id) AS k FROM features) a JOIN (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, feature_id) AS k FROM features) b ON a.chrom = b.chrom AND b.k = a.k + 1""",
}


def with_views(sql: str) -> str:
    """An SQL query with the views it names, and those that they name, before it."""
    import re

    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in needed and re.search(rf"(?<![\w.'\"]){name}\b", text):
                needed.add(name)
                todo.append(SQL[name])
    parts = [f"{name} AS ({SQL[name]})" for name in SQL if name in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Views:
    """The views as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def cov(self) -> DataFrame:
        """Dealt out by features before it is summed: a sum within the splits of the file would take few rows together and hold a whole split's in memory."""
        t = self.table("lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sid"), F.col("l_quantity").cast("long").alias("cov"))
        return dealt(t, ROWS, "feature_id").groupBy("feature_id", "sid").agg(F.sum("cov").alias("cov"))

    @property
    def places(self) -> DataFrame:
        """The features' columns that samples have no part in: without these nothing of cov is summed, which a left join would do for nothing."""
        k = F.col("p_partkey")
        none = F.array().cast("array<string>")
        return self.table("part").select(
            k.alias("feature_id"), F.col("p_brand").alias("chrom"), ((k * 37) % 10000 + 1).alias("start"), ((k * 37) % 10000 + F.col("p_size") * 20).alias("end"), (F.col("p_size") * 20).cast("long").alias("length"),
            F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k % 4 != 0).alias("annotated"),
            F.when(k % 3 == 0, "CT").otherwise("GT").alias("left_motif"), F.when(k % 3 == 0, "AC").otherwise("AG").alias("right_motif"),
            F.when(k % 3 == 0, none).when(k % 3 == 1, F.array("p_type")).otherwise(F.array_sort(F.array("p_type", F.lit("M")))).alias("left_sources"),
            F.when(k % 5 == 0, none).otherwise(F.array("p_type")).alias("right_sources"),
        )

    @property
    def features(self) -> DataFrame:
        lists = self.cov.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("sid", "cov"))).alias("samples"))
        out = self.places.join(lists, "feature_id", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<struct<sid:bigint,cov:bigint>>")))
        return out.withColumns(summary("samples"))

    @property
    def samples(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("rail_id"), F.col("s_name").alias("accession"), F.col("s_acctbal").alias("balance"), F.col("n_name").alias("tissue"), F.col("r_name").alias("study"))

    @property
    def regions(self) -> DataFrame:
        k = F.col("c_custkey")
        start = (k * 53) % 10000 + 1
        mode = F.when(k % 5 == 0, "overlap").when(k % 5 == 1, "contains").when(k % 5 == 2, "exact").when(k % 5 == 3, "start").otherwise("end")
        return self.table("customer").select(k.alias("label"), F.concat(F.lit("Brand#"), (1 + k % 25).cast("string")).alias("b_chrom"), start.alias("b_start"), (start + 100 * (F.col("c_nationkey") + 1)).alias("b_end"), mode.alias("mode"))

    def _orders(self) -> DataFrame:
        return self.table("orders").withColumn("chrom", F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")))

    @property
    def exons(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = (k * 7) % 10000 + 1
        return self._orders().where(k % 3 != 0).select(k.alias("exon"), F.col("o_custkey").alias("tx"), "chrom", start.alias("start"), (start + k % 25).alias("end"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"))

    @property
    def repeats(self) -> DataFrame:
        k = F.col("o_orderkey")
        start = (k * 11) % 10000 + 1
        return self._orders().where(k % 3 == 0).select(k.alias("rep"), "chrom", start.alias("start"), (start + k % 60).alias("end"), F.col("o_orderpriority").alias("class"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))

    @property
    def tx_exons(self) -> DataFrame:
        tx = F.col("l_partkey")
        start = tx % 400 * 20 + (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 1500 + 1
        return self.table("lineitem").select(tx.alias("tx"), F.floor(tx / 2).alias("gene"), F.concat(F.lit("Brand#"), (1 + tx % 25).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("source"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))

    def _hours(self) -> DataFrame:
        hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
        return self.table("events").select(F.col("event_type").alias("chrom"), hour.alias("start"), (hour + 1).alias("end"), F.col("user_id").alias("sid"), F.floor(F.col("value") * 100).alias("cents"))

    @property
    def bases(self) -> DataFrame:
        return self._hours().groupBy("chrom", "start", "end", "sid").agg(F.sum("cents").cast("double").alias("value"))

    @property
    def depth(self) -> DataFrame:
        return self._hours().groupBy("chrom", "start", "end").agg(F.count("*").alias("value"))

    @property
    def texts(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id", "left")

    @property
    def pairs(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("chrom").orderBy("start", "feature_id")
        own = self.features.select("feature_id", "chrom", "start", "end", "annotated")
        following = own.select("*", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("feature_id", "start", "end", "annotated"))).where("n_feature_id is not null")
        return following.select(F.col("feature_id").alias("pair"), "chrom", F.col("start").alias("left_start"), F.col("end").alias("left_end"), F.col("n_start").alias("right_start"), F.col("n_end").alias("right_end"), F.col("annotated").alias("left_annotated"), F.col("n_annotated").alias("right_annotated"), F.col("feature_id").alias("left_id"), F.col("n_feature_id").alias("right_id"))
