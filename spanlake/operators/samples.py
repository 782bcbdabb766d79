"""Sample metadata: search, scores, lookup, groups, and the way from samples to features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions import col
from spanlake.scratch import stored

_BITS = 32768  # of a bitmap bucket: what bitmap_bucket_number deals out
#: Entries, and bitmaps, that one task orders.
ENTRIES, BITMAPS = 1_000_000, 20_000
#: Rows to a task where several steps of it hold all of its rows: sums, orders and windows of the same key.
ROWS = 250_000
#: Bytes of texts that one task cuts into tokens and sorts; a token takes some 90 bytes there, twice.
TEXT = 4_000_000


def tokens(text: Column | str, by: str = "standard") -> Column:
    """Lower-cased terms: runs of letters and digits, or of anything but white space."""
    pattern = r"[^\p{L}\p{N}]+" if by == "standard" else r"\s+"
    return F.filter(F.split(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), pattern), lambda t: t != "")


#: The two ways of cutting a text. A value is found if either way finds it, cut in the same way, as one term or as adjacent ones.
CUTS = ("standard", "space")


def has_term(text: Column | str, term: str, by: str = "standard") -> Column:
    return F.array_contains(tokens(text, by), term.lower())


def has_phrase(text: Column | str, phrase: str, by: str = "standard") -> Column:
    """The phrase's terms stand next to each other; a phrase without terms is nowhere."""
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    wanted = tokens(F.lit(phrase), by)
    return (F.size(wanted) > 0) & F.contains(spaced(tokens(text, by)), spaced(wanted))


def has_value(text: Column | str, value: str) -> Column:
    """Whether either cut finds the value."""
    return has_phrase(text, value, CUTS[0]) | has_phrase(text, value, CUTS[1])


def all_fields(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns if c not in skip))


def condition(df: DataFrame, field: str, op: str, value) -> Column:
    """One metadata predicate. Numbers: = != < <= > >=. Text: `:` for a term or an adjacent phrase by either cut, `!:` for its absence by both (a null text has none). Field `all` is every field."""
    if isinstance(value, (int, float)):
        left, right = F.col(field), F.lit(value)
        return {"=": left == right, ":": left == right, "!=": left != right, "!:": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    text = all_fields(df) if field == "all" else F.col(field)
    found = has_value(text, value)
    return ~found if op.startswith("!") else found


def find_samples(df: DataFrame, predicates: list[tuple]) -> DataFrame:
    """Samples that meet all predicates (field, op, value), by a scan. `find_by_postings` gives the same from an index."""
    for p in predicates:
        df = df.where(condition(df, *p))
    return df


def postings(df: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """cut, field, token, key and at of every token of the fields (all columns but the key, if none are named), by either cut. at is its place in field `all`, whose tokens are
    those of the fields one after the other, and so tells what is adjacent in its own field too.

    A text is cut once for each cut. Texts, not tokens, are dealt out, about TEXT bytes to a task: tokens are many times as large. They are sorted by token
    where they are cut, so that of a written table only pages are read where a token lies, and no task has a frequent token alone.
    """
    fields = [c for c in df.columns if c != key] if fields is None else fields
    names = {(cut, f): f"_{cut}_{i}" for cut in CUTS for i, f in enumerate(fields)}
    size = df.select(sum((F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)) for f in fields), F.lit(0).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0
    texts = df.select(key, *fields).repartition(size // TEXT + 1, key, *fields)
    texts = texts.select(F.col(key).alias("key"), *(tokens(F.col(f), cut).alias(name) for (cut, f), name in names.items()))
    before = lambda cut, f: sum((F.size(names[cut, g]) for g in fields[: fields.index(f)]), F.lit(0))
    lists = F.array(*(F.struct(F.lit(cut).alias("cut"), F.lit(f).alias("field"), F.col(name).alias("tokens"), before(cut, f).alias("before")) for (cut, f), name in names.items()))
    cut = texts.select("key", F.explode(lists).alias("l")).select("key", "l.cut", "l.field", "l.before", F.posexplode("l.tokens").alias("pos", "token"))
    return cut.select("cut", "field", "token", "key", (F.col("before") + F.col("pos")).alias("at")).sortWithinPartitions("token", "cut", "field", "key")


def _terms(posts: DataFrame, value: str) -> dict[str, list[str]]:
    """The value's tokens by each cut, as the postings have them."""
    one = posts.sparkSession.range(1).select(*(tokens(F.lit(value), cut).alias(cut) for cut in CUTS)).first()
    return one.asDict()


def hits(posts: DataFrame, field: str, value: str) -> DataFrame:
    """Distinct keys whose field has the value, by either cut: for each cut, all its tokens one after the other.

    A token's place says where the phrase would begin; where all of its tokens agree, it stands. Rows are dealt out by key and that place, so a frequent token isn't one task.
    """
    found = []
    for cut, terms in _terms(posts, value).items():
        if not terms:
            continue
        places = {t: [i for i, x in enumerate(terms) if x == t] for t in dict.fromkeys(terms)}
        own = posts.where((F.col("cut") == cut) & F.col("token").isin(list(places)))
        own = own if field == "all" else own.where(F.col("field") == field)
        if len(terms) > 1:
            within = F.create_map(*(x for t, p in places.items() for x in (F.lit(t), F.array(*map(F.lit, p)))))[F.col("token")]
            own = own.select("key", F.explode(within).alias("i"), "at").groupBy("key", (F.col("at") - F.col("i")).alias("at")).agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
        found.append(own.select("key"))
    none = posts.select("key").limit(0)
    return reduce(DataFrame.unionByName, found, none).distinct()


def find_by_postings(posts: DataFrame, samples: DataFrame, key: str, predicates: list[tuple]) -> DataFrame:
    """The rows of `samples` that meet all predicates (field, op, value), as `find_samples` gives them, with texts looked up in their postings only.

    Numbers are compared in `samples`, whose texts aren't read. Rows that share a key are found together.
    """
    for field, op, value in predicates:
        if isinstance(value, (int, float)):
            samples = samples.where(condition(samples, field, op, value))
        else:
            found = hits(posts, field, value).withColumnRenamed("key", "_key")
            samples = samples.join(found, samples[key] == found["_key"], "left_anti" if op.startswith("!") else "left_semi")
    return samples


def union_hits(df: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """Samples found by either way of cutting the text, once each."""
    hits = [df.where(has_term(text, term, by)).select(key) for by in ("standard", "space")]
    return hits[0].unionByName(hits[1]).dropDuplicates([key])


def score_samples(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key and score of the samples with any of the terms: the sum of a term's count times ln(N / samples with it)."""
    cut = df.select(key, tokens(text).alias("tokens"))
    wanted = [t.lower() for t in terms]
    times = lambda term: F.size(F.filter("tokens", lambda x: x == term))
    counted = cut.select(key, *(times(t).alias(f"tf{i}") for i, t in enumerate(wanted)))
    sizes = counted.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    part = lambda i: F.when(F.col(f"df{i}") > 0, F.col(f"tf{i}") * F.ln(F.col("n") / F.col(f"df{i}"))).otherwise(F.lit(0.0))
    score = sum((part(i) for i in range(1, len(wanted))), part(0))
    some = sum((F.col(f"tf{i}") for i in range(1, len(wanted))), F.col("tf0")) > 0
    return counted.where(some).join(F.broadcast(sizes)).select(key, score.alias("score"))


def samples_by_id(df: DataFrame, ids: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each id, ascending, its fields as text; `NA` where metadata or a value is missing."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    found = wanted.join(df.select(key, *fields), key, "left")
    return found.select(key, *(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in fields)).orderBy(key)


def fields_at(df: DataFrame, positions: list[int]) -> DataFrame:
    return df.select(*(df.columns[i] for i in positions))


def sids_of(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(group, sid) of the named groups; names: one column."""
    return groups.join(names.select(F.col(names.columns[0]).alias("group")).distinct(), "group").select("group", F.explode("sids").alias("sid"))


def unknown_groups(groups: DataFrame, names: DataFrame) -> DataFrame:
    return names.select(F.col(names.columns[0]).alias("group")).distinct().join(groups, "group", "left_anti")


def long(df: DataFrame, key: str = "feature_id", *more: str) -> DataFrame:
    """A row for each entry of the sample lists: key, sid, cov."""
    return df.select(key, *more, F.explode("samples").alias("_e")).select(key, *more, "_e.sid", "_e.cov")


def sample_index(df: DataFrame, key: str = "feature_id", width: int = 1 << 16) -> DataFrame:
    """sid, bucket and the sorted distinct keys of the sample's features in that bucket of `width` keys, so that no list grows with the table. `sample_bitmaps`
    keeps the same in bits."""
    return long(df, key).groupBy("sid", F.floor(F.col(key) / width).alias("bucket")).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def features_of(df: DataFrame, sids: DataFrame, key: str = "feature_id") -> DataFrame:
    """Distinct keys of features that any of the samples has."""
    return long(df, key).join(sids.select(F.col(sids.columns[0]).alias("sid")).distinct(), "sid", "left_semi").select(key).distinct()


def sample_bitmaps(df: DataFrame, key: str = "feature_id") -> DataFrame:
    """A bitmap of the features of each sample, by bucket of keys (keys count from 0).

    Entries are written first, and dealt to as many tasks as their number asks for: a packed list opens into many times its bytes, which sizes of a shuffle don't tell.
    """
    number = F.col(key) + 1
    entries = stored(long(df, key).select("sid", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit")))
    return dealt(entries, ENTRIES, "sid", "bucket").groupBy("sid", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A written table dealt out by keys (by chance without any), about so many rows to a task, however many there are."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def count_union(bitmaps: DataFrame, sids: DataFrame) -> DataFrame:
    """How many distinct features the samples have together."""
    return features_by_bitmap(bitmaps, sids).select(F.bitmap_count("bits").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_features"))


def bitmap_of(ids: DataFrame) -> DataFrame:
    """bucket and bits of a table of keys (first column)."""
    key = F.col(ids.columns[0]) + 1
    return ids.select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap_union(bitmaps: DataFrame) -> DataFrame:
    """bucket and bits: what any of the bitmaps (bucket, bits, as of several samples) has."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(*bitmaps: DataFrame) -> DataFrame:
    """bucket and bits: what all of the bitmaps have, each with a row for a bucket at most. Buckets that one of them lacks are left out."""
    every = reduce(DataFrame.unionByName, (b.select("bucket", "bits") for b in bitmaps))
    return every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(bitmaps)).drop("n")


def bitmap_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket and bits of `a` that `b` lacks."""
    other = b.select("bucket", F.col("bits").alias("_b"))
    return a.join(other, "bucket", "left").select("bucket", F.when(F.col("_b").isNull(), F.col("bits")).otherwise(_without("bits", "_b")).alias("bits"))


@F.pandas_udf(T.BinaryType())
def _without(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _places(bits: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) for x in bits], dtype=object)


def bitmap_ids(bitmap: DataFrame, name: str = "feature_id") -> DataFrame:
    """The keys of a bitmap (bucket, bits), a bucket at a time."""
    first = (F.col("bucket") - 1) * _BITS
    return bitmap.select(first.alias("_first"), F.explode(_places("bits")).alias("_place")).select((F.col("_first") + F.col("_place")).alias(name))


def features_by_bitmap(bitmaps: DataFrame, sids: DataFrame) -> DataFrame:
    """bucket and bits of the features that any of the samples (first column) has; bitmaps: `sample_bitmaps`, written or not."""
    own = stored(bitmaps.join(sids.select(F.col(sids.columns[0]).alias("sid")).distinct(), "sid", "left_semi").select("bucket", "bits"))
    return bitmap_union(bitmap_parts(own))


def bitmap_parts(bitmaps: DataFrame) -> DataFrame:
    """bucket and bits of a written table of bitmaps, with those that lie in a task together joined: a row for a bucket and task, few of which are ever ordered at once."""
    n = max(1, -(-bitmaps.count() // BITMAPS))
    return dealt(bitmaps.withColumn("_part", F.pmod(F.xxhash64("bits"), F.lit(n))), BITMAPS, "bucket", "_part").groupBy("bucket", "_part").agg(F.bitmap_or_agg("bits").alias("bits")).drop("_part")


def offset_samples(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("samples", F.transform("samples", lambda s: F.struct((s["sid"] + by).alias("sid"), s["cov"].alias("cov"))))


def rekey(samples: DataFrame, ids: DataFrame, accession: str) -> DataFrame:
    """Metadata by integer id instead of accession; ids: accession, sid."""
    return samples.join(ids, accession).select("sid", *(c for c in samples.columns if c != accession))
