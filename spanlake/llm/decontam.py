"""Benchmark decontamination by size-partitioned containment search, with SQL functions only.

Items and documents are sets of five-word shingles; a document is contaminated by an item of which it contains at least 0.8.
Items are partitioned by the size of their sets. An item is searched by its bottom-k MinHash sketch, the k shingles with the smallest
hashes, where k is one more than the shingles that a document may lack at the upper size of the partition: a document that contains
enough of the item has at least one of them, so no recall is lost however long the document is. Candidates are verified on the
shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ROW, stored

SHINGLE, CONTAINMENT = 5, 0.8
#: Rows, or shingles of sets, up to which a table is broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct n-word shingles; fewer words give the whole sequence, none gives none. `words` should be a plain column: it is read once a shingle."""
    last = F.greatest(F.size(words) - n, F.lit(0))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, its distinct shingles and their number, the size partition, and the sketch: hashes of the k smallest."""
    sets = items.select("item_id", words(F.col("text")).alias("words")).select("item_id", shingles(F.col("words")).alias("shingles")).where(F.size("shingles") > 0)
    sets = sets.withColumn("size", F.size("shingles")).withColumn("size_class", F.ceil(F.log2("size")).cast("int"))
    upper = F.pow(F.lit(2), F.col("size_class"))
    k = F.floor(upper * (1 - containment) + 1e-9).cast("int") + 1
    return sets.withColumn("sketch", F.slice(F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s))), 1, F.least(k, F.col("size"))))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and an item that it contains: doc_id, item_id, n_item_shingles, n_shared, containment.

    Items without a word match nothing; an item or text of under five words is one shingle. A pair comes once however often the
    document, or a row with the same doc_id, repeats it (the fullest match counts). Null keys are kept as they are.
    Until a pair is a candidate, a text is known by its doc_id and a hash, so shingles carry neither text nor list; the larger joins are with written tables, whose
    other side adaptive skew joins can split at a frequent shingle or item.
    """
    items = stored(items.select(F.col("item_id"), "text").distinct(), "items").withColumn("item", F.monotonically_increasing_id())
    ids = items.select("item", "item_id")
    known = stored(sketches(items.select(F.col("item").alias("item_id"), "text"), containment).withColumnRenamed("item_id", "item"), "sketches")
    probes = stored(known.select("item", F.explode("sketch").alias("hash")), "probes")
    n_probes, n_items, n_shingles = probes.count(), *known.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).where(F.col("text").isNotNull())
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    hashed = lambda df: df.withColumn("words", words(F.col("text"))).withColumn("shingles", shingles(F.col("words")))
    hits = hashed(marked).select("doc_id", "_text", F.explode(hashes).alias("hash")).join(_sized(probes, n_probes), "hash")
    candidates = stored(hits.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash"), "item").distinct(), "candidates")
    texts = marked.join(_sized(candidates, candidates.count()), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    sets = known.select("item", F.col("shingles").alias("wanted"), "size")
    pairs = hashed(texts.select("doc_id", "text", "item")).withColumnRenamed("shingles", "own").join(_sized(sets, n_shingles), "item")
    pairs = pairs.select("doc_id", "item", "size", F.size(F.array_intersect("own", "wanted")).alias("shared"))
    pairs = pairs.where(F.col("shared") >= containment * F.col("size") - 1e-9)
    found = pairs.join(_sized(ids, n_items), "item").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "size", "shared")).alias("best"))
    return found.select("doc_id", "item_id", F.col("best.size").cast("long").alias("n_item_shingles"), F.col("best.shared").cast("long").alias("n_shared"), "best.containment")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of `docs` that aren't contaminated, all columns. Rows with equal or null doc_id are judged one by one."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    bad = stored(contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), items, containment).select(F.col("doc_id").alias(ROW)).distinct(), "contaminated")
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)
