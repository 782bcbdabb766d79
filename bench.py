"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

and recomputed statistics, and many labelled regions in one join, with their sample lists, also over a table ten times as large, and
beside as many single queries. They read a table of features clustered by place, as the engine keeps it,
which is built once and timed as `load`.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanlake import plans, sources
from spanlake.operators import predicates as P
from spanlake.plans.views import Views

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
#: Queries of the library that are timed as they are.
WHOLE = ("a1_feature_stats", "a2_sample_stats", "a12_feature_studies", "a17_merge_runs", "g14_annotate", "g19_disjoin", "j4_one_end_in_exon", "m14_sample_index", "m15_bitmap_union", "n1_normalise_auc", "w1_assign_ids", "w4_collapse_ranges", "x1_shared_samples")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    views, took = Views(spark, SF_DIR), {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    def written(df):
        df.write.format("noop").mode("overwrite").save()

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/features"
    timed("load", lambda: sources.write_clustered(views.features, path))
    features = spark.read.parquet(path)
    asia = [r.rail_id for r in views.samples.where("study = 'ASIA'").select("rail_id").collect()]
    longest = features.agg(F.max("length")).first()[0]
    regions = views.regions
    shapes = {
        "narrow_region": lambda: P.overlaps(features, "Brand#7", 4000, 4100, max_length=longest),
        "wide_region_and_statistic": lambda: P.query(features, ("Brand#7", 1, 9000), stats=[("samples_count", ">=", 25)]),
        "statistic_only": lambda: P.query(features, stats=[("samples_count", ">=", 28)]),
        "statistic_count": lambda: P.count_ids(P.query(features, stats=[("samples_count", ">=", 5)])),
        "region_and_samples": lambda: P.query(features, ("Brand#7", 1, 9000), stats=[("samples_count", ">=", 5)], sids=asia),
        "bulk_regions": lambda: P.bulk_query(features, regions),
        "bulk_regions_tenfold": lambda: P.bulk_query(spark.read.parquet(tenfold), regions),
        "bulk_filters_and_samples": lambda: P.bulk_query(features, regions.withColumns({"sids": F.array(*map(F.lit, asia)), "min_samples_count": F.lit(5)})),
        "20_regions_in_one_join": lambda: P.bulk_query(features, regions.limit(20)),
    }
    tenfold = path + "-tenfold"
    copies = spark.range(10).withColumnRenamed("id", "_copy")
    features.join(F.broadcast(copies)).withColumns({"feature_id": F.col("feature_id") * 10 + F.col("_copy"), "start": F.col("start") + F.col("_copy"), "end": F.col("end") + F.col("_copy")}).drop("_copy").write.parquet(tenfold)
    few = regions.limit(20).collect()

    def one_by_one():
        for r in few:
            mode = {"contains": {"contains": True}, "exact": {"exact": True}, "start": {"either": "start"}, "end": {"either": "end"}}.get(r.mode, {})
            written(P.query(features, (r.b_chrom, r.b_start, r.b_end), **mode))

    for name, query in shapes.items():
        timed(name, lambda query=query: written(query()))
    timed("20_regions_one_by_one", one_by_one)
    registered = plans.queries()
    for name in WHOLE:
        timed(name, lambda name=name: written(registered[name](spark, SF_DIR)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(SF_DIR.rstrip("/").rpartition("sf")[2])}))
    spark.stop()


if __name__ == "__main__":
    main()
