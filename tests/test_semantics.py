"""Golden cases and the rules that are easy to get wrong."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake import sources
from spanlake.functions import decode_samples, encode_samples, summary
from spanlake.operators import flank, genes, intervals, predicates, quality, samples, stats


@pytest.fixture(scope="module")
def one(spark):
    df = spark.createDataFrame([(1, "chr1", 10, 20, ",5:5,4:32,276:7,18000:276")], "feature_id long, chrom string, start long, end long, text string")
    return stats.feature_stats(df.withColumn("samples", decode_samples("text")))


def test_restrict_and_recompute(one):
    r = predicates.restrict_samples(one, [1, 5, 53, 276, 4987, 18000]).withColumn("text", encode_samples("samples")).first()
    assert (r.text, r.samples_count, r.coverage_sum, r.coverage_avg, r.coverage_median) == (",5:5,276:7,18000:276", 3, 288, 96.0, 7.0)


def test_joined_and_literal_sample_lists_agree(spark, one):
    sids = [1, 5, 53, 276, 4987, 18000]
    joined = predicates.restrict_samples(one, spark.createDataFrame([(s,) for s in sids], "sid long"))
    assert joined.select(*one.columns).collect() == predicates.restrict_samples(one, sids).select(*one.columns).collect()


def test_more_samples_than_a_literal_list(spark, one, monkeypatch):
    from types import SimpleNamespace

    from spanlake.plans import filters

    sids = [5, 4, 276, 99]
    wanted = spark.createDataFrame([(s, "ASIA") for s in sids] + [(18000, "EUROPE")], "rail_id long, study string")
    for most in (1, 2, 3, 4):
        monkeypatch.setattr(predicates, "LITERAL_SIDS", most)
        r = filters.m1_restrict_samples(SimpleNamespace(samples=wanted, features=one)).first()
        assert (r.samples, r.samples_count, r.coverage_sum, r.coverage_median) == (",5:5,4:32,276:7", 3, 44, 7.0)


def test_filters_follow_recomputation(one):
    sids = [1, 5, 53, 276, 4987, 18000]
    kept = [("samples_count", ">", 2), ("coverage_sum", "=", 288), ("coverage_avg", ">=", 3), ("coverage_median", "<", 20)]
    assert predicates.query(one, stats=kept, sids=sids).count() == 1
    assert predicates.query(one, stats=[("coverage_median", "!=", 7)], sids=sids).count() == 0
    assert predicates.query(one, sids=[99]).count() == 0


def test_restricted_mean(spark):
    df = spark.createDataFrame([(1, ",186:2,1005:1,1006:1,1083:1")], "feature_id long, text string").withColumn("samples", decode_samples("text"))
    r = stats.feature_stats(df).first()
    assert (r.samples_count, r.coverage_sum, r.coverage_avg, r.coverage_median) == (4, 5, 1.25, 1.0)


def test_empty_list_has_zeros(spark):
    r = stats.feature_stats(spark.createDataFrame([("",), (None,)], "text string").withColumn("samples", decode_samples("text"))).collect()
    assert all((x.samples_count, x.coverage_sum, x.coverage_avg, x.coverage_median) == (0, 0, 0.0, 0.0) for x in r)


def test_exact_is_not_overlap(one):
    assert predicates.overlaps(one, "chr1", 11, 20).count() == 1
    assert predicates.overlaps(one, "chr1", 11, 20, exact=True).count() == 0
    assert predicates.overlaps(one, "chr1", 20, 30).count() == 1  # closed ends
    assert predicates.overlaps(one, "chr1", 21, 30).count() == 0
    assert predicates.overlaps(one, "chr1", 5, 15, either="start").count() == 1
    assert predicates.overlaps(one, "chr1", 5, 15, either="end").count() == 0
    with pytest.raises(ValueError):
        predicates.in_region("chr1", 1, 2, either="middle")


def test_pushed_filters(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("chrom"), F.col("p_size").alias("start"), F.col("p_partkey").alias("end"))
    plan = predicates.overlaps(df, "Brand#7", 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#7)" in plan and "p_name" not in plan


interval = st.tuples(st.sampled_from(["a", "b"]), st.integers(1, 120), st.integers(0, 60))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, max_size=12), st.lists(interval, max_size=12), st.integers(3, 50))
def test_overlap_join_equals_all_pairs(spark, a, b, width):
    left = [(i, c, s, s + n) for i, (c, s, n) in enumerate(a)]
    right = [(i, c, s, s + n) for i, (c, s, n) in enumerate(b)]
    x = spark.createDataFrame(left, "i long, chrom string, start long, end long")
    y = spark.createDataFrame(right, "j long, b_chrom string, b_start long, b_end long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(x, y, width).collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[3] >= q[2] and p[2] <= q[3])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, min_size=1, max_size=12))
def test_disjoin_covers_each_base_once(spark, rows):
    df = spark.createDataFrame([(c, s, s + n) for c, s, n in rows], "chrom string, start long, end long")
    got = [(r.chrom, p) for r in intervals.disjoin(df, ["chrom"]).collect() for p in range(r.start, r.end + 1)]
    assert sorted(got) == sorted({(c, p) for c, s, n in rows for p in range(s, s + n + 1)})


def test_gap_scan_keeps_the_furthest_end(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 10, 20), ("a", 150, 160)], "chrom string, start long, end long")
    assert [tuple(r) for r in intervals.gaps(df).collect()] == [("a", 100, 150, 51)]


def test_gene_spans_join_near_ends(spark):
    df = spark.createDataFrame([("g", "a", 1, 100), ("g", "a", 10_050, 10_100), ("g", "a", 30_000, 30_001), ("g", "b", 1, 2)], "gene string, chrom string, start long, end long")
    assert sorted(tuple(r) for r in genes.gene_spans(df).collect()) == [("g", "a", 1, 10_100, 2), ("g", "a", 30_000, 30_001, 1), ("g", "b", 1, 2, 1)]


def test_introns_count_backwards_on_minus(spark):
    df = spark.createDataFrame([("t", "-", [0, 100, 200], [10, 110, 210]), ("u", "+", [0], [9])], "tx string, strand string, exon_starts array<long>, exon_ends array<long>")
    assert [tuple(r) for r in genes.introns(df, ["tx"]).collect()] == [("t", "-", 1, 111, 200), ("t", "-", 2, 11, 100)]


def test_types(spark):
    df = spark.createDataFrame([("1", "1", "x", None), ("2", "2.5", "1", "NA"), ("", None, "y", "")], "a string, b string, c string, d string")
    assert {r.field: r.type for r in stats.infer_types(df, df.columns).collect()} == {"a": "i", "b": "f", "c": "t", "d": "n"}
    many = spark.createDataFrame([(str(i),) for i in range(10)] + [("1.5",), ("x",), ("y",)], "a string")
    assert [r.type for r in stats.infer_types(many, ["a"]).collect()] == ["t"]  # integers are out once there is a fraction
    assert [r.type for r in stats.infer_types(many.limit(0), ["a"]).collect()] == ["n"]


def test_half_even_normalisation(spark):
    e = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 9)], "feature_id long, sid long, cov long")
    auc = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 0.0)], "sid long, auc double")
    assert {r.sid: r.norm for r in stats.normalise_auc(e, auc, 1).collect()} == {1: 2, 2: 4, 3: 0}


def test_phrase_and_absence(spark):
    df = spark.createDataFrame([(1, "Liver tissue, adult"), (2, "tissue of liver"), (3, None)], "sid long, t string")
    assert [r.sid for r in samples.find_samples(df, [("t", ":", "liver Tissue")]).collect()] == [1]
    assert [r.sid for r in samples.find_samples(df, [("t", "!:", "adult")]).collect()] == [2, 3]


def test_upper_tail(spark):
    got = spark.range(1).select(*(flank.upper_tail(F.lit(z)).alias(str(i)) for i, z in enumerate((0.0, 1.959964, -1.0)))).first()
    assert [round(x, 5) for x in got] == [0.5, 0.025, 0.84134]


def test_clustered_files_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i % 2}", (i * 37) % 101, (i * 37) % 101 + 5, i) for i in range(200)], "chrom string, start long, end long, id long")
    sources.write_clustered(df, str(tmp_path / "x"), 2)
    for f in (tmp_path / "x").rglob("*.parquet"):
        starts = [r.start for r in spark.read.parquet(str(f)).collect()]
        assert starts == sorted(starts)


def test_shards_are_small(spark, tmp_path):
    df = spark.createDataFrame([("c", i, i + 5, "+") for i in range(1, 60)], "chrom string, start long, end long, strand string")
    sources.write_bed_shards(df, str(tmp_path / "x"), 10)
    assert all(len(f.read_text().splitlines()) <= 10 for f in (tmp_path / "x").glob("*.csv"))


def test_dense_ids_have_no_holes(spark):
    df = spark.createDataFrame([(f"c{i % 3}", i * 7919 % 5000, i) for i in range(300)], "chrom string, start long, k long")
    got = intervals.dense_ids(df, ["k"], width=100).orderBy("id").collect()
    assert [r.id for r in got] == list(range(300))
    assert [(r.chrom, r.start, r.k) for r in got] == sorted((r.chrom, r.start, r.k) for r in got)


def test_multiset_diff(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x long") for xs in ([1, 1, 2], [1, 2, 3]))
    assert sorted(tuple(r) for r in quality.diff(a, b).collect()) == [(1, "first"), (3, "second")]


# rules that were wrong once


def test_group_means_count_members_without_entries(spark):
    e = spark.createDataFrame([("g", 1, 100), ("h", 9, 5), ("k", 3, 2)], "gene string, sid long, cov long")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "sid long, `group` string")
    got = {r.gene: (r.a, r.b, r.c) for r in stats.group_means(e, groups, ["a", "b", "c"]).collect()}
    assert got == {"g": (3.9, 0.0, 0.0), "h": (0.0, 0.0, 0.0), "k": (0.0, 0.7, 0.0)}


def test_top_transcripts_of_each_span(spark):
    tx = spark.createDataFrame([("t1", "c1", 5, 20, 3, False), ("t2", "c2", 5, 20, 4, False), ("t3", "c2", 6, 20, 9, False), ("t4", "c2", 90, 95, 1, True)], "tx string, chrom string, start long, end long, n_exons long, coding boolean")
    spans = spark.createDataFrame([("g", "c1", 1, 30), ("g", "c2", 1, 30), ("g", "c2", 1, 99)], "gene string, b_chrom string, b_start long, b_end long")
    got = sorted((r.b_chrom, r.b_end, r.tx) for r in genes.top_transcripts(tx, spans, 1).collect())
    assert got == [("c1", 30, "t1"), ("c2", 30, "t3"), ("c2", 99, "t4")]


def plain_rank_sum(rows):
    rows = [(v, g) for v, g in rows if v is not None and v == v and g in (0, 1)]
    ones, zeros = [v for v, g in rows if g], [v for v, g in rows if not g]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros), len(ones), len(zeros)


@pytest.mark.parametrize(
    "rows",
    [
        [(1.0, 1), (0.0, 0)],
        [(None, 1), (1.0, 1), (0.0, 0), (None, 0), (5.0, None), (2.0, 7), (float("nan"), 1)],
        [(float(i * 7919 % 400), i % 2) for i in range(900)],
        [(3.0, i % 2) for i in range(9)],
        [(1.0, 1), (2.0, 1)],
        [(1.0, 0)],
        [],
    ],
)
def test_rank_sum(spark, rows):
    r = flank.rank_sum(spark.createDataFrame(rows, "v double, g int"), "v", "g").collect()
    w, n1, n0 = plain_rank_sum(rows)
    assert len(r) == 1 and (r[0].n1, r[0].n0) == (n1, n0) and r[0].w == (w if n1 + n0 else None)
    values = {v for v, g in rows if v is not None and v == v and g in (0, 1)}
    assert (r[0].z is None) == (not n1 or not n0 or len(values) < 2)


def test_rows_that_share_a_key_keep_their_lists(spark, monkeypatch):
    df = stats.feature_stats(spark.createDataFrame([(7, "a", ",1:1,2:9"), (7, "b", ",1:2,3:9"), (7, "b", ",1:2,3:9"), (None, "c", ",1:5"), (8, "d", ",3:1"), (9, "e", "")], "feature_id long, n string, text string").withColumn("samples", decode_samples("text")))
    want = sorted((str(r.feature_id), r.n, r.samples_count, r.coverage_sum) for r in predicates.restrict_samples(df, [1, 2]).collect())
    assert want == [("7", "a", 2, 10), ("7", "b", 1, 2), ("7", "b", 1, 2), ("None", "c", 1, 5)]
    monkeypatch.setattr(predicates, "LITERAL_SIDS", 1)
    for sids in ([1, 2, 2], spark.createDataFrame([(1,), (2,), (2,), (None,)], "sid long")):
        got = predicates.restrict_samples(df, sids)
        assert sorted((str(r.feature_id), r.n, r.samples_count, r.coverage_sum) for r in got.collect()) == want and got.columns == df.columns
    assert predicates.restrict_samples(df, spark.createDataFrame([], "sid long")).count() == 0


def test_equal_junctions_keep_their_motifs(spark):
    seq = spark.createDataFrame([("c", "GTAAAG" * 5)], "chrom string, seq string")
    jx = spark.createDataFrame([("c", 1, 6), ("c", 1, 6), ("d", 1, 6), ("c", 30, 31)], "chrom string, start long, end long")
    got = sorted((r.chrom, r.start, r.left_motif, r.right_motif) for r in genes.motifs(jx, seq, 4).collect())
    assert got == [("c", 1, "GT", "AG"), ("c", 1, "GT", "AG"), ("c", 30, "GN", "GN"), ("d", 1, "NN", "NN")]


def test_holes_of_any_size(spark):
    df = spark.createDataFrame([(1,), (5,), (5,), (5 + 3 * 10**9,)], "k long")
    got = intervals.missing_ids(df, "k")
    assert [r.id for r in got.where("id < 8").orderBy("id").collect()] == [2, 3, 4, 6, 7]
    assert intervals.missing_ids(df.where("k = 1"), "k").count() == 0
    some = spark.createDataFrame([(0,), (2_500_003,)], "k long")
    assert intervals.missing_ids(some, "k").agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (2_500_002, 1, 2_500_002, 2_500_002)


def test_regions_may_share_column_names(spark):
    df = spark.createDataFrame([(1, "c", 5, 9, "m"), (2, "c", 1, 99, "m")], "feature_id long, chrom string, start long, end long, mode string")
    regions = spark.createDataFrame([("c", 5, 9, "exact", 3)], "b_chrom string, b_start long, b_end long, mode string, feature_id long")
    assert [(r.feature_id, r.mode, r.b_mode, r.b_feature_id) for r in predicates.in_regions(df, regions, "mode").collect()] == [(1, "m", "exact", 3)]


def test_nothing_divides_by_zero(spark):
    pairs = spark.createDataFrame([(1, [], [(1, 5)]), (2, [(1, 2)], [(1, 4), (2, 1)]), (3, [], [])], "pair long, left array<struct<sid:long,cov:long>>, right array<struct<sid:long,cov:long>>")
    got = {r.pair: (r.n_shared, r.left_ratio, r.right_ratio, r.shared_avg) for r in flank.shared_samples(pairs).collect()}
    assert got == {1: (0, 0.0, 0.0, -1.0), 2: (1, 1.0, 0.5, 6.0), 3: (0, 0.0, 0.0, -1.0)}
    e = spark.createDataFrame([(1, 1, 0), (1, 2, 4), (2, 2, 0)], "feature_id long, sid long, cov long")
    assert {(r.feature_id, r.sid): r.norm for r in stats.normalise_jxcov(e).collect()} == {(1, 1): 0, (1, 2): 2, (2, 2): 0}
    studies = spark.createDataFrame([(1, "s"), (2, "t")], "sid long, study string")
    assert {(r.feature_id, r.study): r.coverage_percent for r in stats.feature_studies(e, studies).collect()} == {(1, "s"): 0, (1, "t"): 100, (2, "t"): 0}
    bases = spark.createDataFrame([("c", 5, 5, 1, 3.0), ("c", 5, 7, 1, 3.0)], "chrom string, start long, end long, sid long, value double")
    assert {r.end: r.per_base for r in stats.bases_summary(bases).collect()} == {5: None, 7: 1.5}


def test_null_lists_and_coverages(spark):
    df = spark.createDataFrame([(1, None), (2, [(1, None), (2, 4), (3, 6)]), (3, [(1, None)])], "k long, samples array<struct<sid:long,cov:long>>")
    got = {r.k: (r.samples_count, r.coverage_sum, r.coverage_avg, r.coverage_median) for r in stats.feature_stats(df).collect()}
    assert got == {1: (0, 0, 0.0, 0.0), 2: (2, 10, 5.0, 5.0), 3: (0, 0, 0.0, 0.0)}


PLACES = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.integers(0, 90), st.integers(0, 2)), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PLACES, PLACES)
def test_overlaps_at_every_length(spark, xs, ys):
    a = spark.createDataFrame([(i, c, s, s + n * (n if n % 7 == 0 else 1)) for i, (c, s, n, _) in enumerate(xs)], "i long, chrom string, start long, end long")
    b = spark.createDataFrame([(j, c, s, s + n) for j, (c, s, n, _) in enumerate(ys)], "j long, b_chrom string, b_start long, b_end long")
    want = sorted((i, j) for i, (c, s, n, _) in enumerate(xs) for j, (d, t, m, _) in enumerate(ys) if c == d and s <= t + m and s + n * (n if n % 7 == 0 else 1) >= t)
    assert sorted((r.i, r.j) for r in intervals.overlap_join(a, b, 3).collect()) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PLACES)
def test_stretches_change_nothing(spark, xs):
    df = spark.createDataFrame([(c, s, s + n, v) for c, s, n, v in xs], "chrom string, start long, end long, value long")
    for f in (lambda w: intervals.gaps(df, width=w), lambda w: intervals.collapse_ranges(df, "value", width=w)):
        assert sorted(tuple(r) for r in f(7).collect()) == sorted(tuple(r) for r in f(1 << 20).collect())
    runs = sorted((c, s, s + n, v) for c, s, n, v in xs)
    assert sum(1 for i, x in enumerate(runs) if not i or runs[i - 1][0] != x[0] or runs[i - 1][3] != x[3]) == intervals.collapse_ranges(df, "value", width=7).count()


def test_bulk_queries_with_their_own_filters(spark):
    df = stats.feature_stats(
        spark.createDataFrame([(i, "c", i * 10, i * 10 + (5000 if i == 3 else 15), 16, "+-"[i % 2], i % 3 == 0, ["x"] if i % 2 else [], [], f",1:{i},2:{i * i},3:1") for i in range(1, 12)] + [(3, "c", 30, 5030, 16, "-", True, ["x"], [], ",1:3,2:9,3:1")], "feature_id long, chrom string, start long, end long, length long, strand string, annotated boolean, left_sources array<string>, right_sources array<string>, text string")
        .withColumn("samples", decode_samples("text")).drop("text")
    )
    asked = [("a", "c", 1, 60, None, None, None, None, None), ("b", "c", 1, 6000, [1, 3], [("coverage_sum", ">", 4.0), ("samples_count", "=", 2.0)], None, None, None), ("c", "c", 1, 6000, None, [("length", "!=", 16.0)], None, None, None), ("d", "c", 1, 6000, None, None, True, "-", True), ("e", "c", 1, 6000, [], None, None, None, None), ("f", "c", 1, 6000, None, [("nosuch", "=", 1.0)], None, None, None), ("a", "c", 1, 60, None, None, None, None, None)]
    queries = spark.createDataFrame(asked, "label string, b_chrom string, b_start long, b_end long, sids array<long>, filters array<struct<field:string,op:string,value:double>>, annotated_wanted boolean, strand_wanted string, left_wanted boolean")
    got = sorted((r.label, r.feature_id, r.samples_count, r.coverage_sum) for r in predicates.bulk_query(df, queries).collect())
    rows = [(i, i * 10, i * 10 + (5000 if i == 3 else 15), "+-"[i % 2], i % 3 == 0, i % 2 == 1) for i in range(1, 12)] + [(3, 30, 5030, "-", True, True)]
    want = []
    for q in asked:
        for i, s, e, strand, known, left in rows:
            cov = {1: i, 2: i * i, 3: 1}
            kept = cov if q[4] is None else {k: v for k, v in cov.items() if k in q[4]}
            if s <= q[3] and e >= q[2] and (kept or q[4] is None) and (q[6] is None or known == q[6]) and (q[7] is None or strand == q[7]) and (q[8] is None or left == q[8]):
                values = {"coverage_sum": sum(kept.values()), "samples_count": len(kept), "length": 16}
                if all(f in values and {"=": values[f] == x, ">": values[f] > x, "!=": values[f] != x}[op] for f, op, x in q[5] or ()):
                    want.append((q[0], i, len(kept), sum(kept.values())))
    assert got == sorted(want)


def test_dense_ids_of_values(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else f"v{i % 37:03}",) for i in range(500)], "x string")
    got = stats.dense_ids_of(df, "x").orderBy("id").collect()
    assert [r.id for r in got] == list(range(38)) and got[0].x is None and [r.x for r in got[1:]] == sorted(r.x for r in got[1:]) and sum(r.n for r in got) == 500
    assert stats.dense_ids_of(df.limit(0), "x").count() == 0


def test_base_queries(spark):
    bases = spark.createDataFrame([("c", 9, 10, 1, 2.0), ("c", 10, 11, 1, 4.0), ("c", 10, 11, 2, 6.0), ("c", 19, 20, 3, 1.0), ("c", 20, 21, 1, 9.0), ("d", 10, 11, 1, 1.0)], "chrom string, start long, end long, sid long, value double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stats.base_query(bases, ("c", 11, 20))) == [("c", 10, 11, 1, 4.0), ("c", 10, 11, 2, 6.0), ("c", 19, 20, 3, 1.0)]
    assert rows(stats.base_query(bases, ("c", 11, 20), [1, 2, 9], "mean").select("start", "value")) == [(10, 10 / 3)]
    assert rows(stats.base_query(bases, ("c", 11, 20), spark.createDataFrame([(1,), (1,), (3,)], "s long"), "mean", label="L")) == [("c", 10, 11, 2.0, "L"), ("c", 19, 20, 0.5, "L")]
    assert rows(stats.base_query(bases, ("c", 11, 20), None, "mean", "sample")) == [("c:11-20", 1, 2.0), ("c:11-20", 2, 3.0), ("c:11-20", 3, 0.5)]
    assert rows(stats.base_columns(bases, [2], {"g": [1, 3]}).where("chrom = 'c' and start < 20")) == [("c", 9, 10, 0.0, 2.0, 0.0), ("c", 10, 11, 6.0, 4.0, 0.0), ("c", 19, 20, 0.0, 0.0, 1.0)]
    with pytest.raises(ValueError):
        stats.base_query(bases, ("c", 1, 2), None, "mean")


def test_matrix_market_is_one_file_in_parts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"c{i % 3}", i * 5, f",{i % 4}:{i},9:1") for i in range(1, 40)], "feature_id long, chrom string, start long, text string").withColumn("samples", decode_samples("text"))
    order = spark.createDataFrame([(s, k) for k, s in enumerate((0, 1, 2, 3, 9), 1)], "sid long, column long")
    sources.write_matrix_market(df, str(tmp_path / "m"), order)
    lines = "".join(f.read_text() for f in sorted((tmp_path / "m").glob("part-*"))).splitlines()
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == f"39 5 {len(lines) - 2}" and len(lines) == 80
    places = [tuple(map(int, x.split()[:2])) for x in lines[2:]]
    assert places == sorted(places)


LISTS = "array<struct<sid:long,cov:long>>"


def test_shared_coverage_is_that_of_both_sides(spark):
    rows = [(1, [(7, 10), (3, 2)], [(9, 1), (3, 3), (7, 5)]), (2, None, [(1, 1)]), (3, [(1, 1), (2, 8), (5, 1)], [(5, 3), (2, 2), (1, 1), (8, 1)])]
    got = {r.pair: r for r in flank.shared_samples(spark.createDataFrame(rows, f"pair long, left {LISTS}, right {LISTS}")).collect()}
    r = got[1]
    assert (r.shared, r.shared_sum, r.left_sum, r.right_sum, r.shared_avg, r.shared_median, r.left_only, r.right_only) == ([3, 7], 20, 12, 8, 10.0, 10.0, [], [9])
    assert (got[2].shared, got[2].n_shared, got[2].shared_sum, got[2].shared_avg, got[2].shared_median) == ([], 0, 0, -1.0, -1.0)
    assert (got[3].shared, got[3].shared_sum, got[3].shared_median, got[3].right_only) == ([1, 2, 5], 16, 4.0, [8])


def test_products_over_shared_samples(spark):
    left = spark.createDataFrame([("g", 1, 2), ("g", 1, 1), ("g", 2, 5), ("g", 3, 9)], "gene string, sid long, cov long")
    right = spark.createDataFrame([("g", 1, 5), ("g", 2, 4), ("h", 3, 1)], "gene string, sid long, cov long")
    r = flank.all_shared(left, right).first()
    assert (r.n_shared, r.products, r.minima, r.mean, r.median) == (2, 35, 7, 17.5, 17.5)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (["a", "b", "c"], ["b", "a", "d"], (0.0, 2 / 3, 2 / 3, False, True)),
        (["a", "b", "c", "d"], ["a", "x"], (0.5, 0.5, 0.25, True, False)),
        (["a"], ["a", "b"], (1.0, 1.0, 1.0, True, False)),
        (["?", "a", "b"], ["b", "?", "a"], (0.0, 1.0, 1.0, False, True)),
        ([], ["a"], (0.0, 0.0, 0.0, False, False)),
        (None, None, (0.0, 0.0, 0.0, False, False)),
    ],
)
def test_ranked_lists(spark, a, b, want):
    r = flank.compare_ranked(spark.createDataFrame([(a, b)], "a array<string>, b array<string>")).first()
    assert (r.place_rate, r.top_overlap, r.overlap, r.first_match, r.first_in_two) == want


def test_group_names_keep_their_case(spark):
    rows = [(1, "Brain - Cortex", 1), (2, "brain cortex", 1), (3, "TCGA-BRCA", 11), (4, "CCLE-BRCA", 9), (5, None, 1), (6, "", 1)]
    df = spark.createDataFrame(rows, "rail_id long, name string, code int")
    assert {r.group: r.sids for r in stats.build_groups(df, F.col("name")).collect()} == {"Brain_-_Cortex": [1], "brain_cortex": [2], "BRCA": [3, 4], "NA": [5, 6]}
    assert {r.group for r in stats.build_groups(df, F.col("name"), code=F.col("code")).collect()} >= {"BRCA_normal", "BRCA_tumor"}


def test_range_filters_on_fractions_agree_in_both_paths(spark, one):
    df = one.withColumns({"samples_count": F.lit(5).cast("long"), "length": F.lit(11).cast("long")})
    for op, want in {"<": 1, "<=": 1, ">": 0, ">=": 0, "=": 0, "!=": 1}.items():
        asked = spark.createDataFrame([(1, "chr1", 1, 99, [("samples_count", op, 5.5)])], "label long, b_chrom string, b_start long, b_end long, filters array<struct<field:string,op:string,value:double>>")
        assert predicates.where_stat(df, "samples_count", op, 5.5).count() == predicates.bulk_query(df, asked).count() == want


def test_exact_rank_sums(spark):
    """Published values, and the share of all ways to choose the first group, for small groups."""
    from itertools import combinations

    def p(ones, zeros):
        return flank.rank_sum(spark.createDataFrame([(float(v), 1) for v in ones] + [(float(v), 0) for v in zeros], "v double, g int"), "v", "g").first().p

    assert abs(p([3, 4], [1, 2]) - 1 / 6) < 1e-12
    for n1, n0 in ((1, 1), (1, 5), (3, 4), (4, 2)):
        for pick in [*combinations(range(n1 + n0), n1)][::7]:
            ways = [sum(c) for c in combinations(range(n1 + n0), n1)]
            want = sum(w >= sum(pick) for w in ways) / len(ways)
            assert abs(p(pick, [v for v in range(n1 + n0) if v not in pick]) - want) < 1e-12
    tied = flank.rank_sum(spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "v double, g int"), "v", "g").first()
    assert abs(tied.z - (3.5 - 2 - 0.5) / (4 / 12 * (5 - 6 / 12)) ** 0.5) < 1e-12 and 0 < tied.p < 0.5


SAMPLES = [(1, "SRP-12 lung", "a b", 5), (2, "(SRP-12), it's", "b", 6), (3, "srp 12", None, 7), (4, "SRP-123 its", "SRP-12", 8), (5, None, "", 9), (6, "lung-cancer cells lung", "x", 1), (7, "cancer cells the the end", "of the", 2)]


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ([("t", ":", "SRP-12")], {1, 2, 3}),
        ([("t", "!:", "SRP-12")], {4, 5, 6, 7}),
        ([("t", ":", "it's")], {2}),
        ([("t", "!:", "IT'S")], {1, 3, 4, 5, 6, 7}),
        ([("t", ":", "(srp-12),")], {1, 2, 3}),
        ([("t", ":", "cancer cells")], {6, 7}),
        ([("t", ":", "lung-cancer  cells")], {6}),
        ([("t", ":", "the the end")], {7}),
        ([("t", ":", "the the the")], set()),
        ([("all", ":", "srp-12")], {1, 2, 3, 4}),
        ([("t", ":", "lung"), ("t", "!:", "srp"), ("n", "<", 5)], {6}),
        ([("t", ":", "srp"), ("u", ":", "b"), ("n", ">=", 5)], {1, 2}),
        ([("t", ":", "!!")], set()),
        ([("t", "!:", "!!")], {1, 2, 3, 4, 5, 6, 7}),
    ],
)
def test_postings_find_what_a_scan_finds(spark, asked, want):
    df = spark.createDataFrame(SAMPLES, "k long, t string, u string, n long")
    posts = samples.postings(df, "k", ["t", "u"]).cache()
    assert {r.k for r in samples.find_by_postings(posts, df, "k", asked).collect()} == want
    texts = [(f, op, v) for f, op, v in asked]
    assert {r.k for r in samples.find_samples(df.select("k", "t", "u", "n"), [p for p in texts if p[0] != "all"]).collect()} == want or asked[0][0] == "all"


@given(st.lists(st.tuples(st.lists(st.integers(0, 30), max_size=12), st.lists(st.one_of(st.none(), st.integers(0, 30)), max_size=9)), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_hash_tables_hold_their_lists(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "_list long, a array<long>, sids array<long>")
    tables = predicates.hash_tables(df.select("_list", "sids"))
    got = df.join(tables, "_list").select("_list", F.filter("a", lambda x: predicates.has_id(F.col("table"), x)).alias("kept"))
    assert {r._list: r.kept for r in got.collect()} == {i: [x for x in a if x in b] for i, (a, b) in enumerate(rows)}


def test_long_intervals_are_not_copied_into_every_bin(spark):
    points = spark.createDataFrame([("c", i * 37) for i in range(300)] + [("c", 5000)] * 200, "chrom string, at long")
    places = spark.createDataFrame([("c", 1, 8_000_000), ("c", 4000, 6000), ("c", 5000, 5000), ("c", 9, 3), ("d", 1, 9)], "b_chrom string, b_start long, b_end long")
    got = intervals.stab_join(points, places, "at")
    rows = points.collect()
    want = sorted((p.at, r.b_start) for p in rows for r in places.collect() if r.b_chrom == "c" and r.b_start <= p.at <= r.b_end)
    assert sorted((r.at, r.b_start) for r in got.collect()) == want


def test_matrices_have_one_array_however_many_samples(spark, tmp_path):
    """Fifty thousand samples make no larger plan than three."""
    n = 50_000
    bases = spark.range(n).selectExpr("'c' AS chrom", "id % 3 AS start", "id % 3 + 1 AS end", "id * 7 AS sid", "cast(id AS double) + 0.5 AS value")
    few = stats.coverage_matrix(bases.where("sid < 21"))
    many = stats.coverage_matrix(bases.where("sid >= 0"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(few) == size(many)
    got = {r.start: r["values"] for r in many.collect()}
    assert {k: len(v) for k, v in got.items()} == {0: n, 1: n, 2: n}
    assert all(got[i % 3][i] == i + 0.5 and got[(i + 1) % 3][i] == 0 for i in range(0, n, 997))
    assert {r.start: r["values"] for r in few.collect()} == {0: [0.5, 0, 0], 1: [0, 1.5, 0], 2: [0, 0, 2.5]}
    wanted = spark.createDataFrame([(0, 14), (1, 99), (2, 0), (3, 14)], "at long, sid long")
    assert {r.start: r["values"] for r in stats.base_rows(bases, wanted).collect()} == {0: [0, 0, 0.5, 0], 2: [2.5, 0, 0, 2.5]}
    (tmp_path / "a.tsv").write_text("chrom\tstart\tend\t" + "\t".join(str(7 * i) for i in range(n)) + "\nc\t1\t2\t" + "\t".join(str(i) for i in range(n)) + "\n")
    (tmp_path / "b.tsv").write_text("chrom\tstart\tend\t5\t0\nd\t3\t4\t\t2.5\nd\t4\t5\tNA\t\n")
    back = sources.read_bases(spark, str(tmp_path))
    assert back.count() == n + 1 and [tuple(r) for r in back.where("chrom = 'd'").collect()] == [("d", 3, 4, 0, 2.5)]
    assert back.where("sid = 7 * value").count() == n


def test_one_long_feature_widens_no_scan(spark, tmp_path):
    """Over a table with a feature as long as the chromosome, a region's scan skips most row groups, and finds what a plain filter finds."""
    n = 60_000
    rows = spark.range(n).selectExpr("id AS feature_id", "'c' AS chrom", "id * 20 + 1 AS start", "id * 20 + 1 + CASE WHEN id = 5 THEN 20 * 60000 WHEN id % 1000 = 7 THEN 9000 ELSE id % 90 END AS end")
    rows = rows.unionByName(spark.createDataFrame([(-1, "c", 900_000, 900_000 + 10**9)], rows.schema))
    path = str(tmp_path / "levelled")
    spark.conf.set("parquet.block.size", 16 << 10)
    spark._jsc.hadoopConfiguration().setInt("parquet.block.size", 16 << 10)
    spark._jsc.hadoopConfiguration().setInt("parquet.page.size.row.check.min", 10)
    try:
        sources.write_levelled(rows, path, width=100, partitions=1)
    finally:
        for key in ("parquet.block.size", "parquet.page.size.row.check.min"):
            spark._jsc.hadoopConfiguration().unset(key)
        spark.conf.unset("parquet.block.size")
    found = predicates.overlaps(spark.read.parquet(path), "c", 700_000, 700_500, levels="level", width=100)
    plan = found._jdf.queryExecution().executedPlan()
    got = {r.feature_id for r in found.collect()}
    assert got == {r.feature_id for r in predicates.overlaps(rows, "c", 700_000, 700_500).collect()} and 5 in got
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() < n / 5
    for lo, hi in ((1, 1), (900_000, 950_000), (1_199_000, 5_000_000), (40, 20_000)):
        both = [predicates.overlaps(df, "c", lo, hi, **more).select("feature_id").collect() for df, more in ((rows, {}), (spark.read.parquet(path), {"levels": "level", "width": 100}))]
        assert sorted(both[0]) == sorted(both[1])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.one_of(st.none(), st.integers(-5, 5), st.integers(0, 10**6))), max_size=40), st.sampled_from([2, 3, 256]))
def test_divided_medians(spark, rows, blocks):
    before, stats.MEDIAN_BLOCKS = stats.MEDIAN_BLOCKS, blocks
    try:
        got = {r.k: r["median"] for r in stats.medians(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    finally:
        stats.MEDIAN_BLOCKS = before
    from statistics import median

    want = {k: [v for x, v in rows if x == k and v is not None] for k, _ in rows}
    assert got == {k: median(v) for k, v in want.items() if v}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("cd"), st.integers(0, 60), st.integers(1, 9), st.integers(1, 3), st.integers(-3, 9)), max_size=25), st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("cd"), st.integers(0, 70), st.integers(-2, 40)), max_size=8), st.sampled_from([4, 50, 1 << 20]))
def test_interval_sums_by_running_sums(spark, rows, places, width):
    """Equal to a sum over all pairs, for rows that overlap and intervals that repeat, too."""
    bases = spark.createDataFrame([(c, s, s + n, sid, float(v)) for c, s, n, sid, v in rows], "chrom string, start long, end long, sid long, value double")
    named = spark.createDataFrame([(label, c, s, s + n) for label, c, s, n in places], "label string, b_chrom string, b_start long, b_end long")
    got = {(r.label, r.sid, r.chrom): (r.start, r.end, r.value, r.length) for r in stats.interval_sums(bases, named, width).collect()}
    pairs = {}
    for c, s, n, sid, v in rows:
        for label, chrom, lo, size in places:
            if chrom == c and lo <= lo + size and s + n >= lo and s + 1 <= lo + size:
                pairs.setdefault((label, sid, c), []).append((s + 1, s + n, v))
    assert got == {k: (min(x[0] for x in v), max(x[1] for x in v), sum(x[2] for x in v), max(x[1] for x in v) - min(x[0] for x in v) + 1) for k, v in pairs.items()}


MODES = ["overlap", "contains", "exact", "start", "end", None]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PLACES, st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.integers(-2, 90), st.sampled_from(MODES)), max_size=25))
def test_questions_to_the_furthest_end_equal_all_pairs(spark, xs, ys):
    df = spark.createDataFrame([(i, c, s, s + n) for i, (c, s, n, _) in enumerate(xs)], "feature_id long, chrom string, start long, end long")
    regions = spark.createDataFrame([(c, s, s + n, m) for c, s, n, m in ys], "b_chrom string, b_start long, b_end long, mode string")
    asks = {"contains": lambda s, e, a, b: s >= a and e <= b, "exact": lambda s, e, a, b: s == a and e == b, "start": lambda s, e, a, b: s >= a, "end": lambda s, e, a, b: e <= b}
    meets = lambda s, e, a, b, m: a <= b and s <= b and e >= a and asks.get(m, lambda *_: True)(s, e, a, b)
    want = sorted(i for i, (c, s, n, _) in enumerate(xs) if any(c == d and meets(s, s + n, a, a + k, m) for d, a, k, m in ys))
    assert sorted(r.feature_id for r in predicates.in_regions(df, regions, "mode", distinct="feature_id").collect()) == want
    got = intervals.any_covers(df, regions, {"inside": ("start", "end"), "held": ("end", "end")}, width=37)
    holds = lambda c, x, y: any(c == d and k >= 0 and a <= x and a + k >= y for d, a, k, _ in ys)
    assert {r.feature_id: (r.inside, r.held) for r in got.collect()} == {i: (holds(c, s, s + n), holds(c, s + n, s + n)) for i, (c, s, n, _) in enumerate(xs)}


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_existence_makes_no_pairs_and_nothing_exploded_is_broadcast(spark, sf_dir):
    """Questions whether any interval holds a place need no interval join, and no join with exploded bins is planned as a broadcast."""
    from spanlake import plans

    queries = plans.queries()
    for name in ("j4_one_end_in_exon", "f15_count_ids", "f6_regions_distinct"):
        assert "_bin" not in joins(queries[name](spark, sf_dir)), name
    for name in ("j1_overlap_join", "j2_stab_join", "j3_same_gene", "j5_end_in_repeat", "j9_label_overlaps", "j10_intron_repeat_pairs", "b1_bulk_query"):
        plan = joins(queries[name](spark, sf_dir))
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_bin" in line], name
        assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "pow" in line.lower()], name


@pytest.mark.parametrize("name", ["j6_sense_flags", "j6_repeat_study", "j7_rel_by_sample", "j8_rel_fractions"])
def test_plans_of_sense_stay_small(spark, sf_dir, name):
    """What the driver plans doesn't multiply with the questions asked one after the other, and lineitem isn't summed for places alone."""
    from spanlake import plans

    plan = joins(plans.queries()[name](spark, sf_dir))
    assert plan.count("Exchange ") < 50 and plan.count("Scan parquet") < 30
    if name == "j7_rel_by_sample":  # entries stay as they were dealt out, flags are brought to them
        assert plan.count("Exchange ") <= 4 and "Broadcast" not in plan
    assert plan.count("lineitem.parquet") <= {"j7_rel_by_sample": 1, "j8_rel_fractions": 2}.get(name, 0)


def test_fractions_of_samples_take_one_pass_over_the_entries(spark, sf_dir):
    from spanlake import plans

    plan = joins(plans.queries()["j8_rel_fractions"](spark, sf_dir))
    assert plan.count("lineitem.parquet") == 1 and len([x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]) == 1
    entries = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 1, 1), (3, 3, 4), (3, 14, 9), (1, 14, 2), (4, 4, None)], "feature_id long, sid long, cov long")
    flags = spark.createDataFrame([(1, True, False, False), (2, True, True, True)], "feature_id long, gene_sense boolean, repeat_sense boolean, both_sense boolean")
    names = ["n", "n_both", "n_gene", "n_repeat", "coverage"]
    one = {r.sid: r for r in flank.rel_by_sample(entries, flags).collect()}
    got = {r.sid: r for r in flank.rel_by_sample(entries, flags, counted=F.col("sid") != 14).collect()}
    assert {k: tuple(r[c] for c in names) for k, r in one.items()} == {1: (2, 1, 2, 1, 6), 2: (1, 0, 1, 0, 7), 14: (1, 0, 1, 0, 2)}
    assert {k: tuple(r[c] for c in names) for k, r in got.items() if r.n is not None} == {k: tuple(r[c] for c in names) for k, r in one.items()}
    assert all(got[k][c] is None for k in (3, 4) for c in names)
    assert {k: (r.n_total, r.coverage_total) for k, r in got.items()} == {1: (2, 6), 2: (1, 7), 3: (1, 4), 4: (1, 0), 14: (0, 0)}
    samples_ = spark.createDataFrame([(1,), (3,), (14,), (20,)], "sid long")
    fractions = flank.rel_fractions(flank.rel_by_sample(entries, flags, counted=F.col("sid") != 14), samples_, spark.createDataFrame([(3,)], "sid long"))
    assert {tuple(r) for r in fractions.collect()} == {(1, 1.0, 1.0, False), (3, None, None, True), (14, None, None, False), (20, None, None, False)}


def test_questions_asked_one_after_the_other_plan_the_rows_once(spark):
    df = spark.range(4).selectExpr("'c' AS chrom", "id AS start", "id + 2 AS end")
    own = spark.createDataFrame([("c", 1, 2)], "b_chrom string, b_start long, b_end long")
    out = df
    for name in ("p", "q", "r"):
        out = intervals.any_covers(out, own, {name: ("start", "start"), f"{name}_whole": ("start", "end")})
    assert joins(out).count("Range (") == 1
    assert sorted((r.start, r.p, r.r, r.q_whole) for r in out.collect()) == [(0, False, False, False), (1, True, True, False), (2, True, True, False), (3, False, False, False)]


@pytest.mark.parametrize("name", ["a9_sparse_from_wide", "x4_tissue_breakdown", "g9_splice_sites"])
def test_sums_and_orders_are_of_bounded_numbers_of_rows(spark, sf_dir, monkeypatch, name):
    """Rows are dealt out by their number, and before anything is summed or ordered; one further shuffle at most gathers what is left of them."""
    from spanlake import plans
    from spanlake.plans import views

    for module in (views, genes):
        monkeypatch.setattr(module, "ROWS", 1000, raising=False)
    n = -(-views.Views(spark, sf_dir).table("lineitem").count() // 1000)
    plan = joins(plans.queries()[name](spark, sf_dir)).splitlines()
    dealt = next(i for i, line in enumerate(plan) if f", {n}), REPARTITION_BY_NUM" in line)
    assert not [line for line in plan[dealt + 1 :] if ("Aggregate" in line or "Sort" in line) and line.index("+-") > plan[dealt].index("+-")]
    assert len([line for line in plan[:dealt] if "Exchange hashpartitioning" in line]) == (name != "x4_tissue_breakdown")


def test_bulk_pairs_are_not_shuffled(spark, sf_dir):
    from spanlake import plans

    for name in ("b1_bulk_query", "b1_bulk_filters"):
        plan = joins(plans.queries()[name](spark, sf_dir)).splitlines()
        met = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line and "_bin" in line)
        assert not [line for line in plan[:met] if "Exchange" in line], name


@pytest.mark.parametrize("in_row", [0, 500])
def test_lists_of_samples_are_named_and_no_row_gets_a_copy(spark, sf_dir, monkeypatch, in_row):
    """Queries name their list; long lists are asked by entries, a few to a task, with the same result as short ones that come into the row."""
    from spanlake import plans

    monkeypatch.setattr(predicates, "IN_ROW_IDS", in_row)
    monkeypatch.setattr(predicates, "ENTRIES", 5)
    text = [(1, 10, ",3:1,1:5,9:2"), (1, 10, ",3:1,1:5,9:2"), (1, 40, ",1:7"), (2, 10, ""), (3, 12, ",9:4,2:8"), (4, 500, ",1:1")]
    df = spark.createDataFrame([(i, "c", s, s + 5, t) for i, s, t in text], "feature_id long, chrom string, start long, end long, text string").withColumn("samples", decode_samples("text")).drop("text")
    df = df.withColumns(summary("samples"))
    lists = {"p": [1, 3, 3, None], "q": [9], "none": [None]}
    asked = [("a", 1, 20, "p"), ("b", 1, 99, "q"), ("c", 11, 99, "none"), ("d", 40, 99, "lost"), ("a", 1, 20, "p")] + [("e", 1, 20, None)] * (in_row > 0)
    queries = spark.createDataFrame([(a, "c", s, e, k) for a, s, e, k in asked], "label string, b_chrom string, b_start long, b_end long, list string")
    members = spark.createDataFrame([(k, x) for k, v in lists.items() for x in v], "list string, sid long")
    out = predicates.bulk_query(df, queries, lists=members)
    assert out.columns == [*df.columns, *queries.columns]
    got = sorted((r.label, r.feature_id, r.start, tuple((x.sid, x.cov) for x in r.samples), r.samples_count, r.coverage_sum) for r in out.collect())
    want = []
    for label, s, e, name in asked:
        for i, at, t in text:
            entries = tuple(tuple(map(int, x.split(":"))) for x in t.split(",") if x)
            kept = entries if name is None else tuple(x for x in entries if x[0] in lists.get(name, []))
            if at <= e and at + 5 >= s and (kept or name is None):
                want.append((label, i, at, kept, len(kept), sum(c for _, c in kept)))
    assert got == sorted(want)
    plan = joins(plans.queries()["b1_bulk_with_samples"](spark, sf_dir))
    top, *rest = [line for line in plan.splitlines() if "SortMergeJoin" in line and "_bin" in line]
    assert "Exchange" not in plan[: plan.index(top)] and plan.count("lineitem.parquet") == 0
    assert ("table#" in plan) == (in_row > 0)


def test_genes_of_several_intervals_and_junctions_at_several_places(spark):
    df = spark.createDataFrame([(1, "c", 5, 50, "+"), (2, "c", 5, 20, "-"), (3, "c", 50, 5, "+"), (4, "c", 5, 6, "+"), (4, "c", 50, 51, "+"), (5, "d", 5, 50, "+")], "feature_id long, chrom string, start long, end long, strand string")
    genes = spark.createDataFrame([("c", 1, 9, "g", "+"), ("c", 45, 60, "g", "+"), ("c", 1, 60, "h", "-"), ("c", 1, 30, "k", "-"), ("c", 9, 2, "z", "+")], "b_chrom string, b_start long, b_end long, gene string, strand string")
    got = {r.feature_id: r.genes for r in flank.same_gene(df, genes.drop("strand")).collect()}
    assert got == {1: ["g", "h"], 2: ["h", "k"], 3: ["g", "h"], 4: ["g", "h", "k"]}
    assert sorted(r.feature_id for r in flank.in_same_gene(df, genes).collect()) == [1, 2, 3, 4]
    assert sorted((r.feature_id, r.strand) for r in flank.in_same_gene(df, genes, strand="strand").where("feature_id <> 4").collect() if r.feature_id != 2) == [(1, "+"), (3, "+")]


def test_wide_coverage_of_more_samples_than_a_pivot_takes(spark, tmp_path):
    n = 12_000
    bases = spark.range(n).selectExpr("'c' AS chrom", "id % 3 AS start", "id % 3 + 1 AS end", "id * 7 AS sid", "cast(id AS double) + 0.5 AS value")
    sources.write_bases(bases, str(tmp_path / "wide"))
    back = sources.read_bases(spark, str(tmp_path / "wide"))
    assert back.count() == n and back.exceptAll(bases).count() == 0


def test_bounds_ask_what_the_filters_ask(spark):
    one = lambda *fs: [(f, o, v) for f, o, v in fs]
    lists = [None, [], one(("length", ">", 5.0), ("length", "<=", 9.0)), one(("length", "=", 7.0)), one(("length", "=", 7.0), ("length", "=", 8.0)), one(("coverage_avg", "<", 2.5), ("length", "!=", 7.0)), one(("nosuch", ">", 1.0)), one(("length", "~", 1.0)), one(("length", ">", None)), one((None, ">", 1.0)), one(("coverage_avg", ">=", float("nan"))), one(("coverage_avg", ">", 0.0))]
    asked = spark.createDataFrame(list(enumerate(lists)), "q int, filters array<struct<field:string,op:string,value:double>>")
    rows = [(i, n, n, n, a, a) for i, (n, a) in enumerate([(5, 1.0), (7, 2.5), (8, 2.0), (9, None), (10, float("nan"))])]
    df = spark.createDataFrame(rows, "i int, length long, samples_count long, coverage_sum long, coverage_avg double, coverage_median double")
    columns, test = predicates.bounds(F.col("filters"))
    plain = lambda pairs: sorted((r.q, r.i) for r in pairs.collect())
    assert plain(asked.withColumns(columns).crossJoin(df).where(test)) == plain(asked.crossJoin(df).where(predicates.passes(F.col("filters"))))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 70), st.integers(1, 4), st.booleans()), max_size=25), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 70)), max_size=8))
def test_top_transcripts_are_those_of_all_pairs(spark, tx, spans):
    own = [(i, "c", s, s + n, e, c) for i, (s, n, e, c) in enumerate(tx)] + [(999, "c", 9, 3, 9, True)]
    asked = [(g, "c", s, s + n) for g, (s, n) in enumerate(spans)] + [(998, "d", 1, 99), (997, "c", 50, 40)]
    a = spark.createDataFrame(own, "tx long, chrom string, start long, end long, n_exons long, coding boolean")
    b = spark.createDataFrame(asked, "gene long, b_chrom string, b_start long, b_end long")
    got = sorted((r.gene, r["rank"], r.tx) for r in genes.top_transcripts(a, b, 3).collect())
    want = []
    for g, c, s, e in asked:
        met = sorted((-(n + 100_000 * k), i) for i, x, y, z, n, k in own if x == c and y <= z and s <= e and z >= s and y <= e)
        want += [(g, r + 1, i) for r, (_, i) in enumerate(met[:3])]
    assert got == sorted(want)


def test_top_transcripts_make_no_pairs(spark):
    """A crowd of transcripts on a crowd of spans: what is joined stays in proportion to both."""
    a = spark.range(3000).selectExpr("id AS tx", "'c' AS chrom", "id % 50 AS start", "id % 50 + 5000 AS end", "id % 7 AS n_exons", "true AS coding")
    b = spark.range(3000).selectExpr("id AS gene", "'c' AS b_chrom", "id % 40 AS b_start", "id % 40 + 4000 + id AS b_end")
    out = genes.top_transcripts(a, b, 2)
    assert out.count() == 6000
    metrics = out._jdf.queryExecution().executedPlan().toString()
    assert "b_start" in metrics and not any("<=" in line and "b_end" in line and "Join" in line for line in metrics.splitlines())


def test_bitmaps_are_made_by_tasks_of_a_bounded_number_of_entries(spark, monkeypatch):
    """Lists that open into many entries are dealt out by these, not by the bytes of the lists."""
    monkeypatch.setattr(samples, "ENTRIES", 100)
    monkeypatch.setattr(samples, "BITMAPS", 3)
    df = spark.range(60).selectExpr("id * 1000 AS feature_id", "transform(sequence(1, 20), s -> struct(s AS sid, 1L AS cov)) AS samples")
    bitmaps = samples.sample_bitmaps(df)
    assert bitmaps.rdd.getNumPartitions() == 12
    some = spark.createDataFrame([(3,), (4,), (9,)], "sid int")
    assert sorted(r[0] for r in samples.bitmap_ids(samples.features_by_bitmap(bitmaps, some)).collect()) == [i * 1000 for i in range(60)]
    assert samples.count_union(bitmaps, some.limit(0)).first()[0] == 0


def test_postings_cut_a_text_once_and_hold_all_fields_in_the_same_rows(spark):
    df = spark.createDataFrame([(1, "a-b C", None, "d"), (2, "x", "a b", "c d"), (3, None, None, "")], "k long, t string, u string, v string")
    posts = samples.postings(df, "k").cache()
    assert posts.where("cut = 'standard'").count() == 4 + 5  # no row of their own for field `all`
    assert [r.token for r in posts.where("cut = 'standard' and key = 2").orderBy("at").collect()] == ["x", "a", "b", "c", "d"]
    find = lambda field, value: {r.key for r in samples.hits(posts, field, value).collect()}
    assert (find("all", "c d"), find("all", "b c d"), find("all", "x a"), find("t", "x a"), find("v", "c d")) == ({1, 2}, {1, 2}, {2}, set(), {2})
    assert "range" not in samples.postings(df, "k")._jdf.queryExecution().executedPlan().toString().lower().replace("scan", "")


def test_tests_of_a_feature_are_made_once_for_each_set_of_them(spark, sf_dir, monkeypatch):
    """A pair is asked for a bit, which is compiled: no array of filters, no mode's name. More sets than KINDS give the same, pair by pair."""
    from spanlake import plans

    joined = joins(plans.queries()["b1_bulk_filters"](spark, sf_dir))
    met = next(line for line in joined.splitlines() if "SortMergeJoin" in line and "_bin" in line)
    assert "lambda" not in met and "overlap" not in met and "contains" not in met
    df = stats.feature_stats(spark.createDataFrame([(i, "c", i * 10, i * 10 + 15, 16, "+-"[i % 2], None if i % 5 == 0 else i % 3 == 0, f",1:{i},2:{i * i}") for i in range(1, 12)], "feature_id long, chrom string, start long, end long, length long, strand string, annotated boolean, text string").withColumn("samples", decode_samples("text")).drop("text"))
    tests = [None, [], [("coverage_sum", ">", 30.0), ("length", "<=", 16.5)], [("coverage_sum", "!=", 42.0)], [("nosuch", "=", 1.0)], [("length", "=", None)], [None], [("coverage_median", "~", 1.0)]]
    asked = [(i, "c", 1 + i % 7, 90 + i % 9, mode, f, None if i % 4 else 40 + i % 3, [None, "+", "-"][i % 3], [True, None, False][i // 3 % 3]) for i, (f, mode) in enumerate((f, m) for f in tests for m in ("overlap", "contains", "exact", "start", "end", None, "other"))]
    asked += [(900 + i, "c", 10 * i, 10 * i + 15, "exact", None, None, None, None) for i in range(3)] + [(i, "c", 1, 999, "overlap", None, i - 1000, None, None) for i in range(1000, 1070)]
    queries = spark.createDataFrame(asked, "label long, b_chrom string, b_start long, b_end long, mode string, filters array<struct<field:string,op:string,value:double>>, min_coverage_sum long, strand_wanted string, annotated_wanted boolean")
    got = lambda q: sorted((r.label, r.feature_id) for r in predicates.bulk_query(df, q).collect())
    own = [(r.feature_id, r.start, r.end, r.strand, r.annotated, {"coverage_sum": r.coverage_sum, "length": 16, "coverage_median": r.coverage_median}) for r in df.collect()]
    compare = {">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b, "=": lambda a, b: a == b}
    fits = {"contains": lambda s, e, x, y: s >= x and e <= y, "exact": lambda s, e, x, y: (s, e) == (x, y), "start": lambda s, e, x, y: s >= x, "end": lambda s, e, x, y: e <= y}
    holds = lambda f, v: f is not None and f[0] in v and f[1] in compare and f[2] is not None and compare[f[1]](v[f[0]], f[2])
    want = sorted((q[0], i) for q in asked for i, s, e, strand, known, v in own if e >= q[2] and s <= q[3] and fits.get(q[4], lambda *_: True)(s, e, q[2], q[3]) and all(holds(f, v) for f in q[5] or ()) and (q[6] is None or v["coverage_sum"] >= q[6]) and q[7] in (None, strand) and (q[8] is None or known is not None and known == q[8]))
    assert len(want) > 400 and got(queries) == want and got(queries.limit(0)) == []
    for name, bound in (("KINDS", 5), ("KIND_FILTERS", 1)):
        with monkeypatch.context() as m:
            m.setattr(predicates, name, bound)
            assert got(queries) == want


def test_postings_are_sorted_where_texts_are_cut(spark, monkeypatch):
    """Texts are dealt out, a bounded number of bytes to a task, and no row of a token is shuffled or told its place twice."""
    monkeypatch.setattr(samples, "TEXT", 100)
    df = spark.createDataFrame([(i if i else None, f"of the w{i} x", None if i % 2 else "the end") for i in range(60)], "k long, t string, u string")
    posts = samples.postings(df, "k")
    plan = joins(posts)
    assert plan.count("Exchange") == 1 and "Generate" not in plan[plan.index("Exchange") :]
    assert posts.columns == ["cut", "field", "token", "key", "at"]
    parts = posts.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("token").alias("tokens")).collect()
    assert len(parts) > 4 and all(r.tokens == sorted(r.tokens) for r in parts)
    assert samples.hits(posts, "u", "the end").count() == 30 and samples.hits(posts, "all", "x the end").count() == 30 and samples.hits(posts, "t", "of the").count() == 60
    assert samples.postings(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("keys", [1, 3, 10_000])
def test_lists_of_genes_are_made_where_places_and_genes_meet(spark, sf_dir, monkeypatch, keys):
    """No pair and no list is shuffled, whatever the place's junctions, and a list takes its form once for a place."""
    from spanlake import plans

    monkeypatch.setattr(flank, "KEYS", keys)
    plan = joins(plans.queries()["j3_same_gene"](spark, sf_dir)).splitlines()
    met = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line and "_bin" in line)
    made = next(i for i, line in enumerate(plan) if "array_join" in line)
    assert not [line for line in plan[:met] if "Exchange" in line] and "explode" not in "".join(plan[made:met]) and "explode" in "".join(plan[:made])
    at = [(5, 50), (5, 50), (50, 5), (5, 50), (5, 5), (7, 9000), (40, 41), (None, 5), (5, None), (39, 70), (100, 110), (5, 6), (60, 61)]
    own = [(i, "c", s, e) for i, (s, e) in enumerate(at)] + [(11, "c", 39, 60), (90, None, 5, 50), (91, "d", 5, 50), (None, "c", 7, 8)]
    genes = [("c", 1, 60, 1), ("c", 1, 60, 2), ("c", 1, 60, 2), ("c", 5, 5, 3), ("c", 1, 9500, 4), ("c", 1, 9, 5), ("c", 45, 60, 5), ("c", 30, 80, 6), ("c", 9, 2, 7), (None, 1, 60, 8), ("c", 7, 9000, 9), ("c", 39, 42, None)]
    df = spark.createDataFrame(own, "feature_id long, chrom string, start long, end long")
    got = flank.same_gene(df, spark.createDataFrame(genes, "b_chrom string, b_start long, b_end long, gene long"), width=10, form=lambda x: F.array_join(x.cast("array<string>"), ",")).collect()
    holds = lambda g, chrom, at: any(x == g and c == chrom and at is not None and s <= at <= e for c, s, e, x in genes)
    both = lambda i, g: all(any(holds(g, c, r[side]) for k, c, *r in own if k == i) for side in (0, 1))
    want = {i: ",".join(str(g) for g in (1, 2, 3, 4, 5, 6, 9) if both(i, g)) for i in {r[0] for r in own}}
    assert {r.feature_id: r.genes for r in got if r.genes} == {k: v for k, v in want.items() if v} and len(got) == len({r.feature_id for r in got})


def test_regions_are_copied_to_levels_that_features_have(spark, sf_dir):
    """Of six levels the features here have one or two; pairs stay those of all levels."""
    from spanlake import plans
    from spanlake.plans.views import Views

    assert "array(0,1)" in joins(plans.queries()["j1_overlap_join"](spark, sf_dir)).replace(" ", "").replace("[", "array(").replace("]", ")") and "lineitem" not in joins(plans.queries()["j1_overlap_join"](spark, sf_dir))
    assert intervals.levels_of(Views(spark, sf_dir).places, 500) == [0, 1]
    a = spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate([(1, 1), (1, 90), (50, 700), (9, 100_000), (7, 3), (None, 8), (8, None)])], "i long, chrom string, start long, end long")
    b = spark.createDataFrame([(j, "c", s, e) for j, (s, e) in enumerate([(1, 9), (80, 95), (600, 2000), (99_000, 99_001), (1, 200_000)])], "j long, b_chrom string, b_start long, b_end long")
    pairs = lambda levels, a: sorted((r.i, r.j) for r in intervals.overlap_join(a, b, 10, levels=levels).collect())
    assert len(intervals.levels_of(a, 10)) == 4 and pairs(None, a) == pairs(intervals.levels_of(a, 10), a) and len(pairs(None, a)) > 9
    assert pairs(intervals.levels_of(a.limit(0), 10), a.limit(0)) == []
