"""The text operators as queries over the test tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import audit, cmix, decontam, density, fim, forest, langid, licenses, pow2pack, simhash, toxzstd, warczst, weakq
from spanlake.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold. Null texts and texts without letters are `und`; see `langid.predict`."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document under the mixing model and the base model; a null text counts as empty. See `cmix.score_texts`."""
    return cmix.score_texts(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every document; a null text counts as empty. See `weakq.judge`."""
    return weakq.judge(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document; a null text counts as empty. See `licenses.scan`."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from labels outside the held-out fold; a null text counts as empty. See `toxzstd.classify`."""
    return toxzstd.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; a null page gives an empty one. See `density.main_text`."""
    return density.main_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, each a sequence of its own; a null text gives its end alone. See `pow2pack.pack`."""
    return pow2pack.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; a null text counts as empty. See `simhash.classes`."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains; null texts and items contain nothing. See `decontam.contaminated`."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a null page is an empty payload. See `warczst.round_trip`."""
    return warczst.round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose by language, order and step; null texts count as empty. See `audit.interactions`."""
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document rearranged for filling in the middle, and of the text restored from that; a null text counts as empty. See `fim.digests`."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and kept of every document by its shingle set; texts without a word are linked with nothing. See `forest.near_duplicates`."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the table of documents; see `corpus_pipeline.run`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_lm_score, op3_quality, op4_licenses, op5_toxicity, op6_main_text, op7_packing, op8_simhash, op9_decontamination, op10_warc, op11_filter_audit, op12_fill_in_middle, op13_minhash_dedup, pipeline)
    return {f.__name__: f for f in every}


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END"


def oracle_sql() -> dict[str, str]:
    return {
        "op9_decontamination": f"""
WITH d AS (SELECT doc_id, unnest(s) AS shingle FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
i AS (SELECT item_id, unnest(s) AS shingle, len(s) AS size FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, CAST(size AS BIGINT) AS n_item_shingles, count(*) AS n_shared, count(*) / CAST(size AS DOUBLE) AS containment
FROM i JOIN d USING (shingle) GROUP BY doc_id, item_id, size HAVING count(*) >= 8e-1 * size - 1e-9""",
        "op11_filter_audit": """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
fails AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM words LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step, x, n, good, bad, contains(f, x) AS fails, f = x AS alone,
    before <> '' AND regexp_matches(f, '[' || CASE WHEN before = '' THEN '0' ELSE before END || ']') AS gone FROM cells, steps),
counted AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted""",
    }
