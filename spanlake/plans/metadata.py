"""Sample sets and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import predicates as P
from spanlake.operators import samples as S
from spanlake.operators import stats as A
from spanlake.plans.register import Register
from spanlake.scratch import stored

register = Register()

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_JOINED = rf"concat(' ', array_to_string({_TOKENS}, ' '), ' ')"
_GROUPS = "(SELECT lower(tissue) AS g, min(tissue) AS long_name, count(*) AS n, list(rail_id ORDER BY rail_id) AS sids FROM samples GROUP BY 1)"
_NAME = "concat(CASE rail_id % 3 WHEN 0 THEN 'TCGA-' WHEN 1 THEN 'CCLE-' ELSE '' END, tissue, ' - ', study)"
_CLEAN = f"replace(replace(replace({_NAME}, 'TCGA-', ''), 'CCLE-', ''), ' ', '_')"
_ASKED = ("NATION_3_-_EUROPE", "NATION_4_-_MIDDLE_EAST", "nation_3_-_europe", "NATION_4 - MIDDLE EAST", "atlantis")


def _name():
    k = F.col("rail_id") % 3
    return F.concat(F.when(k == 0, "TCGA-").when(k == 1, "CCLE-").otherwise(""), "tissue", F.lit(" - "), "study")


def _groups(v):
    return A.build_groups(v.samples, _name())


@register(f"SELECT {_CLEAN} AS \"group\", rail_id AS sid FROM samples WHERE {_CLEAN} IN {_ASKED}")
def m3_sids_of_groups(v):
    names = v.spark.createDataFrame([(x,) for x in _ASKED], "name string")
    return S.sids_of(_groups(v), names)


@register(f"SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _ASKED)}) t(\"group\") WHERE \"group\" NOT IN (SELECT {_CLEAN} FROM samples)")
def m3_unknown_groups(v):
    names = v.spark.createDataFrame([(x,) for x in _ASKED], "name string")
    return S.unknown_groups(_groups(v), names)


@register("SELECT doc_id, n_chars FROM texts WHERE n_chars >= 2000 AND n_chars < 4000 AND quality = 1")
def m4_numeric(v):
    return S.find_samples(v.texts, [("n_chars", ">=", 2000), ("n_chars", "<", 4000), ("quality", "=", 1)]).select("doc_id", "n_chars")


def _postings(v):
    """Postings of all fields of the texts, written once and read from there."""
    return stored(S.postings(v.texts.select("doc_id", "text", "lang", "source"), "doc_id"))


@register(f"SELECT doc_id FROM texts WHERE list_contains({_TOKENS}, 'theaou')")
def m5_term(v):
    return S.find_samples(v.texts, [("text", ":", "Theaou")]).select("doc_id")


@register(f"SELECT doc_id FROM texts WHERE contains({_JOINED}, ' of the ')")
def m6_phrase(v):
    return S.find_samples(v.texts, [("text", ":", "of The")]).select("doc_id")


@register(r"""SELECT doc_id FROM (SELECT doc_id, concat_ws(' ', text, lang, source) AS text FROM texts) WHERE list_contains(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''), 'src7')""")
def m7_all_fields(v):
    return S.find_samples(v.texts.select("doc_id", "text", "lang", "source"), [("all", ":", "src7")]).select("doc_id")


@register(f"SELECT doc_id FROM texts WHERE n_chars > 1000 AND list_contains({_TOKENS}, 'the') AND NOT contains({_JOINED}, ' of the ')")
def m8_and(v):
    return S.find_samples(v.texts, [("n_chars", ">", 1000), ("text", ":", "the"), ("text", "!:", "of the")]).select("doc_id")


@register(f"SELECT doc_id FROM texts WHERE list_contains({_TOKENS}, 'theaou')")
def m5_term_by_postings(v):
    return S.find_by_postings(_postings(v), v.texts, "doc_id", [("text", ":", "Theaou")]).select("doc_id")


_SIGNED = r"concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(accession), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' '), ' ')"


@register(f"SELECT rail_id, '#' AS term FROM samples WHERE contains({_SIGNED}, ' supplier 000000007 ') UNION ALL SELECT rail_id, '!' FROM samples WHERE NOT contains({_SIGNED}, ' supplier 000000007 ')")
def m5_term_with_a_sign(v):
    """A term that one cut divides and the other keeps, and its negation."""
    own = v.samples.select("rail_id", "accession")
    posts = stored(S.postings(own, "rail_id"))
    found = {"#": (":", "Supplier#000000007"), "!": ("!:", "supplier#000000007")}
    return P.any_of([S.find_by_postings(posts, own, "rail_id", [("accession", *p)]).select("rail_id", F.lit(k).alias("term")) for k, p in found.items()])


@register(f"SELECT doc_id FROM texts WHERE contains({_JOINED}, ' of the ')")
def m6_phrase_by_postings(v):
    return S.find_by_postings(_postings(v), v.texts, "doc_id", [("text", ":", "of The")]).select("doc_id")


@register(f"SELECT doc_id FROM texts WHERE n_chars > 1000 AND list_contains({_TOKENS}, 'the') AND NOT contains({_JOINED}, ' of the ') AND lang = 'en' AND source <> 'src7'")
def m8_and_by_postings(v):
    """Several predicates over one table of postings: a number, terms of two fields and of all, a phrase's absence."""
    asked = [("n_chars", ">", 1000), ("text", ":", "the"), ("text", "!:", "of the"), ("lang", ":", "EN"), ("source", "!:", "src7")]
    return S.find_by_postings(_postings(v), v.texts, "doc_id", asked).select("doc_id")


@register("SELECT feature_id, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum FROM cov JOIN samples ON rail_id = sid WHERE balance > 5000 AND study = 'EUROPE' GROUP BY 1")
def m13_features_by_postings(v):
    posts = stored(S.postings(v.samples.select("rail_id", "study", "tissue"), "rail_id"))
    sids = S.find_by_postings(posts, v.samples, "rail_id", [("balance", ">", 5000), ("study", ":", "europe")]).select("rail_id")
    return P.restrict_samples(v.features.select("feature_id", "samples"), sids, stats="basic").drop("samples")


@register(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM texts), k AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'src' OR x = 'license')) AS b FROM t),
n AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM k) SELECT doc_id, round(a * ln(n / na) + CASE WHEN nb > 0 THEN b * ln(n / nb) ELSE 0e0 END, 9) AS score FROM k, n WHERE a + b > 0""")
def m9_score(v):
    return S.score_samples(v.texts, "doc_id", "text", ["the", "license"]).withColumn("score", F.round("score", 9))


@register(rf"SELECT doc_id FROM texts WHERE list_contains({_TOKENS}, 'and') OR list_contains(regexp_split_to_array(lower(text), '\s+'), 'and')")
def m10_union_hits(v):
    return S.union_hits(v.texts, "doc_id", "text", "and")


@register("SELECT i AS doc_id, coalesce(lang, 'NA') AS lang, coalesce(CAST(quality AS VARCHAR), 'NA') AS quality FROM (SELECT DISTINCT o_orderkey % 5000 AS i FROM orders) LEFT JOIN texts ON doc_id = i")
def m11_samples_by_id(v):
    ids = v.table("orders").select((F.col("o_orderkey") % 5000).alias("id"))
    return S.samples_by_id(v.texts, ids, "doc_id", ["lang", "quality"])


@register("SELECT rail_id, tissue, study FROM samples")
def m12_field_positions(v):
    return S.fields_at(v.samples, [0, 3, 4])


@register("SELECT feature_id, count(*) AS samples_count, CAST(sum(cov) AS BIGINT) AS coverage_sum FROM cov JOIN samples ON rail_id = sid WHERE balance > 5000 AND study = 'EUROPE' GROUP BY 1")
def m13_features_by_metadata(v):
    sids = S.find_samples(v.samples, [("balance", ">", 5000), ("study", ":", "europe")]).select("rail_id")
    return P.restrict_samples(v.features.select("feature_id", "samples"), sids, stats="basic").drop("samples")


@register("SELECT sid, feature_id // 256 AS bucket, string_agg(CAST(feature_id AS VARCHAR), ',' ORDER BY feature_id) AS ids FROM cov GROUP BY 1, 2")
def m14_sample_index(v):
    return S.sample_index(v.features, width=256).select("sid", "bucket", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register("SELECT DISTINCT feature_id FROM cov JOIN samples ON rail_id = sid WHERE tissue LIKE '%1'")
def m15_features_of(v):
    return S.features_of(v.features, v.samples.where("tissue like '%1'").select("rail_id"))


@register("SELECT count(DISTINCT feature_id) AS n_features FROM cov JOIN samples ON rail_id = sid WHERE tissue LIKE '%1'")
def m15_bitmap_union(v):
    return S.count_union(S.sample_bitmaps(v.features), v.samples.where("tissue like '%1'").select("rail_id"))


@register("SELECT DISTINCT feature_id FROM cov JOIN samples ON rail_id = sid JOIN part ON p_partkey = feature_id WHERE tissue LIKE '%1' AND p_type = 'ECONOMY'")
def m16_ids_and_samples(v):
    ids = v.table("part").where("p_type = 'ECONOMY'").select("p_partkey")
    return P.by_ids(S.features_of(v.features, v.samples.where("tissue like '%1'").select("rail_id")), ids)


@register("SELECT DISTINCT feature_id FROM cov JOIN samples ON rail_id = sid WHERE tissue LIKE '%1'")
def m15_features_by_bitmap(v):
    return S.bitmap_ids(S.features_by_bitmap(S.sample_bitmaps(v.features), v.samples.where("tissue like '%1'").select("rail_id")))


@register("SELECT DISTINCT feature_id FROM cov JOIN samples ON rail_id = sid WHERE tissue LIKE '%1' AND feature_id NOT IN (SELECT feature_id FROM cov JOIN samples ON rail_id = sid WHERE study = 'ASIA')")
def m15_bitmap_difference(v):
    bitmaps = stored(S.sample_bitmaps(v.features))
    some, other = (S.features_by_bitmap(bitmaps, v.samples.where(c).select("rail_id")) for c in ("tissue like '%1'", "study = 'ASIA'"))
    return S.bitmap_ids(S.bitmap_difference(some, other))


@register("SELECT DISTINCT feature_id FROM cov JOIN samples ON rail_id = sid JOIN part ON p_partkey = feature_id WHERE tissue LIKE '%1' AND p_type = 'ECONOMY' AND feature_id IN (SELECT feature_id FROM cov JOIN samples ON rail_id = sid WHERE study = 'ASIA')")
def m16_ids_and_samples_by_bitmap(v):
    """Ids and two sets of samples met in bits; no list of a feature is opened once the bitmaps stand."""
    bitmaps = stored(S.sample_bitmaps(v.features))
    some, other = (S.features_by_bitmap(bitmaps, v.samples.where(c).select("rail_id")) for c in ("tissue like '%1'", "study = 'ASIA'"))
    return S.bitmap_ids(S.bitmap_intersection(some, other, S.bitmap_of(v.table("part").where("p_type = 'ECONOMY'").select("p_partkey"))))


@register("SELECT feature_id, string_agg(concat(',', sid + 1000, ':', cov), '' ORDER BY sid) AS samples FROM cov GROUP BY 1")
def m17_offset_samples(v):
    from spanlake.functions import encode_samples

    return S.offset_samples(v.features.where(F.size("samples") > 0), 1000).select("feature_id", encode_samples("samples").alias("samples"))


@register("SELECT rail_id * 2 AS sid, balance, tissue FROM samples WHERE rail_id % 9 <> 0")
def m19_rekey(v):
    ids = v.samples.where("rail_id % 9 <> 0").select("accession", (F.col("rail_id") * 2).alias("sid"))
    return S.rekey(v.samples.select("accession", "balance", "tissue"), ids, "accession")


@register(f"SELECT concat({_CLEAN}, CASE WHEN rail_id % 20 >= 10 THEN '_normal' ELSE '_tumor' END) AS \"group\", min({_NAME}) AS long_name, count(*) AS n, string_agg(CAST(rail_id AS VARCHAR), ',' ORDER BY rail_id) AS sids FROM samples GROUP BY 1")
def a16_build_groups(v):
    out = A.build_groups(v.samples, _name(), code=F.col("rail_id") % 20)
    return out.withColumn("sids", F.array_join(F.transform("sids", lambda x: x.cast("string")), ","))


@register(f"SELECT {_CLEAN} AS \"group\", min({_NAME}) AS long_name, count(*) AS n, string_agg(CAST(rail_id AS VARCHAR), ',' ORDER BY rail_id) AS sids FROM samples WHERE rail_id % 3 = 1 GROUP BY 1")
def a16_build_groups_of_first_replicates(v):
    out = A.build_groups(v.samples, _name(), run=F.concat_ws(".", "accession", (F.col("rail_id") % 3).cast("string")))
    return out.withColumn("sids", F.array_join(F.transform("sids", lambda x: x.cast("string")), ","))


@register("SELECT * FROM samples")
def s21_all_samples(v):
    return v.samples.select("*")
