"""Predicates on regions, statistics, annotation and ids, and the query that ANDs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions import keep_samples, summary
from spanlake.model import STANDARD_CHROM
from spanlake.operators.intervals import BIN, FACTOR, LEVELS, any_covers, levels_of, merged, overlap_join
from spanlake.operators.samples import ENTRIES
from spanlake.scratch import stored

#: Type of each statistic that a range filter may name.
STATISTICS = {"length": "long", "samples_count": "long", "coverage_sum": "long", "coverage_avg": "double", "coverage_median": "double"}
#: Explicit sample lists up to this length stay in the expression; longer ones are joined.
LITERAL_SIDS = 5000
#: Ids of all distinct lists of a bulk query up to which tables of them are broadcast.
BROADCAST_IDS = 1_000_000
#: Ids of a list up to which its hash table is copied to each row that asks for it.
IN_ROW_IDS = 500
#: Distinct sets of tests of a bulk query, and range filters in all of them, up to which features are tested by each set before they meet a query.
KINDS, KIND_FILTERS = 512, 2000
#: Sets of tests whose outcomes share a number: bits of a long without its sign.
KIND_BITS = 63


def in_region(chrom: str, start: int, end: int, exact: bool = False, contains: bool = False, either: str | None = None, max_length: int | None = None, levels: str | None = None, width: int = BIN) -> Column:
    """Closed overlap, and what the flags ask besides; they compose. max_length, the longest feature of the chromosome, lets a scan skip what starts too early. levels, the column
    with which `write_levelled` lays a table out (and its width), does so for each level apart: the region becomes a range of starts of every level, which Parquet statistics can prune."""
    tests = [F.col("chrom") == chrom, F.col("end") >= start, F.col("start") <= end]
    if max_length is not None:
        tests.append(F.col("start") >= start - max_length + 1)
    if levels is not None:
        low = [(F.col(levels) == k) & (F.col("start") >= start - width * FACTOR**k + 1) for k in range(LEVELS - 1)]
        tests.append(reduce(lambda a, b: a | b, low, F.col(levels) == LEVELS - 1))
    if exact:
        tests += [F.col("start") == start, F.col("end") == end]
    if contains:
        tests += [F.col("start") >= start, F.col("end") <= end]
    if either == "start":
        tests.append(F.col("start") >= start)
    elif either == "end":
        tests.append(F.col("end") <= end)
    elif either is not None:
        raise ValueError("either is 'start' or 'end'")
    return reduce(lambda a, b: a & b, tests)


def overlaps(df: DataFrame, chrom: str, start: int, end: int, **mode) -> DataFrame:
    return df.where(in_region(chrom, start, end, **mode))


def mode_condition(mode: Column, start: str = "b_start", end: str = "b_end") -> Column:
    """Of a joined pair, what a mode column (overlap, contains, exact, start, end) asks besides overlap."""
    s, e, qs, qe = F.col("start"), F.col("end"), F.col(start), F.col(end)
    return F.when(mode == "contains", (s >= qs) & (e <= qe)).when(mode == "exact", (s == qs) & (e == qe)).when(mode == "start", s >= qs).when(mode == "end", e <= qe).otherwise(True)


def mode_flags(mode: Column) -> tuple[dict[str, Column], Column]:
    """What `mode_condition` asks in booleans that are worked out once for a region, and the test of a pair by these, which compares no text."""
    one_of = lambda *names: F.coalesce(mode.isin(*names), F.lit(False))
    columns = {"_from": one_of("contains", "exact", "start"), "_upto": one_of("contains", "exact", "end"), "_exact": one_of("exact")}
    s, e, qs, qe = F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")
    return columns, (~F.col("_from") | (s >= qs)) & (~F.col("_upto") | (e <= qe)) & (~F.col("_exact") | ((s == qs) & (e == qe)))


def in_regions(df: DataFrame, regions: DataFrame, mode: str | None = None, distinct: str | None = None, width: int = BIN) -> DataFrame:
    """Rows of `df` once for each region (b_chrom, b_start, b_end, more) that they meet; distinct: a key to come once only.

    mode: the column of `regions` that says what else a row must do. A column that both tables have comes from the regions as b_<name>. With `distinct`
    no pair is made: each mode is a question to the furthest end so far along the chromosome, exact places are looked up.
    """
    if distinct is None:
        return overlap_join(df, regions, width, mode_condition(F.col(f"b_{mode}" if mode in df.columns else mode)) if mode is not None else None)
    places = regions.select("b_chrom", "b_start", "b_end", (F.col(mode) if mode is not None else F.lit("overlap")).alias("_mode")).where("b_start <= b_end")
    out = rows = df.where("start <= end")
    tests = {"contains": ("start", "end"), "start": ("start", "start"), "end": ("end", "end")} if mode is not None else {}
    for name, test in tests.items():
        out = any_covers(out, places.where(F.col("_mode") == name), {f"_{name}": test}, points=rows)
    plain = places.where(~F.coalesce(F.col("_mode").isin("exact", *tests), F.lit(False))) if mode is not None else places
    out = any_covers(out, plain, {"_overlap": ("end", "start")}, points=rows)
    found = ["_overlap", *(f"_{k}" for k in tests)]
    if mode is not None:
        exact = places.where("_mode = 'exact'").select(F.col("b_chrom").alias("chrom"), F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct().withColumn("_exact", F.lit(True))
        out = out.join(exact.hint("merge"), ["chrom", "start", "end"], "left")
        found.append("_exact")
    return out.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit(False)) for c in found))).dropDuplicates([distinct]).select(*df.columns)


def where_stat(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """A range filter (= != < <= > >=). A value that isn't whole is compared as such with whole numbers too: a count of 5 is below 5.5."""
    if column not in STATISTICS:
        raise ValueError(f"no statistic {column!r}")
    left, right = F.col(column), F.lit(int(value)) if float(value).is_integer() else F.lit(float(value))
    tests = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
    return df.where(tests[op])


def where_annotated(df: DataFrame, side: str, wanted: bool) -> DataFrame:
    """side: both (column annotated), left or right (any source)."""
    has = F.col("annotated") if side == "both" else F.size(f"{side}_sources") > 0
    return df.where(has if wanted else ~has)


def where_strand(df: DataFrame, strand: str) -> DataFrame:
    return df.where(F.col("strand") == strand)


def by_ids(df: DataFrame, ids: DataFrame | list[int], key: str = "feature_id") -> DataFrame:
    """Rows whose key is in a list or in a one-column table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.where(F.col(key).isin([int(x) for x in ids]))


def count_ids(df: DataFrame, key: str = "feature_id") -> DataFrame:
    return df.agg(F.countDistinct(key).alias("n_ids"))


def standard_chroms(df: DataFrame, pattern: str = STANDARD_CHROM) -> DataFrame:
    return df.where(F.col("chrom").rlike(pattern))


def valid_regions(df: DataFrame, digits: int = 10) -> Column:
    """Whether text columns start and end are numbers of at most so many digits in order."""
    number = rf"^[0-9]{{1,{digits}}}$"
    return F.coalesce(F.col("start").rlike(number) & F.col("end").rlike(number) & (F.expr("try_cast(start AS BIGINT)") <= F.expr("try_cast(end AS BIGINT)")), F.lit(False))


def split_annotated(df: DataFrame, wanted: str) -> DataFrame:
    """known, novel or both."""
    return df if wanted == "both" else where_annotated(df, "both", wanted == "known")


def restrict_samples(df: DataFrame, sids: list[int] | DataFrame, stats: str = "full", key: str = "feature_id") -> DataFrame:
    """Features with the given samples' entries only, in stored order, those without any left out, and statistics of what is left.

    sids: a list, or a table (first column). Up to LITERAL_SIDS distinct ids go into the expression and stay in the row; to tell that of a table, as many
    ids and one more are read. More ids are joined to the entries, which come back to their row by its key and a hash of the whole row: rows that share a
    key stay apart, equal rows get equal lists. Null ids match nothing.
    stats: full, or basic for count and sum alone.
    """
    if isinstance(sids, DataFrame):
        wanted = sids.select(F.col(sids.columns[0]).cast("long").alias("sid")).where("sid is not null").distinct()
        some = wanted.limit(LITERAL_SIDS + 1).collect()
        sids = wanted if len(some) > LITERAL_SIDS else [r.sid for r in some]
    elif len(sids) > LITERAL_SIDS:
        sids = df.sparkSession.createDataFrame([(int(x),) for x in set(sids)], "sid long")
    if isinstance(sids, DataFrame):
        own = df.withColumn("_row", F.xxhash64(*df.columns))
        entries = own.select(key, "_row", F.posexplode("samples").alias("pos", "entry")).select(key, "_row", "pos", "entry.sid", "entry.cov").join(sids, "sid", "left_semi")
        lists = entries.groupBy(F.col(key).alias("_key"), F.col("_row").alias("_r")).agg(F.array_sort(F.collect_set(F.struct("pos", "sid", "cov"))).alias("_kept"))
        kept = own.join(lists, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_r")))
        kept = kept.withColumn("samples", F.transform("_kept", lambda e: F.struct(e["sid"].alias("sid"), e["cov"].alias("cov")))).drop("_kept", "_row", "_key", "_r")
    else:
        kept = df.withColumn("samples", keep_samples("samples", sids)).where(F.size("samples") > 0)
    found = summary("samples")
    if stats == "basic":
        found = {k: found[k] for k in ("samples_count", "coverage_sum")}
        kept = kept.drop("coverage_avg", "coverage_median")
    return kept.withColumns(found)


def query(df: DataFrame, region: tuple | None = None, stats: list[tuple] = (), ids=None, sids=None, annotated: dict | None = None, strand: str | None = None, fields: list[str] | None = None, **mode) -> DataFrame:
    """All given predicates ANDed. Cheap tests come first; with samples, statistics are recomputed before their filters apply."""
    if region is not None:
        df = overlaps(df, *region, **mode)
    for side, wanted in (annotated or {}).items():
        df = where_annotated(df, side, wanted)
    if strand is not None:
        df = where_strand(df, strand)
    if ids is not None:
        df = by_ids(df, ids)
    if sids is not None:
        df = restrict_samples(df, sids)
    for column, op, value in stats:
        df = where_stat(df, column, op, value)
    return df.select(*fields) if fields else df


def any_of(parts: list[DataFrame]) -> DataFrame:
    """A bag union of query results."""
    return reduce(DataFrame.unionByName, parts)


def union_splits(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """The outputs of several splits (name: rows) under one header, with the split of each row; a column that a split lacks is null there. Without a split there is nothing to tell the columns: an error."""
    if not parts:
        raise ValueError("union_splits needs a split")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(name, F.lit(k)) for k, df in parts.items()))


def passes(filters: Column) -> Column:
    """Whether a feature passes all of its row's range filters, an array of (field, op, value); null or empty asks nothing, an unknown field or op fails."""

    def test(f):
        value = reduce(lambda c, k: c.when(f["field"] == k, F.col(k).cast("double")), STATISTICS, F.when(F.lit(False), F.lit(0.0)))
        wanted = f["value"].cast("double")
        tests = {"=": value == wanted, "!=": value != wanted, "<": value < wanted, "<=": value <= wanted, ">": value > wanted, ">=": value >= wanted}
        return F.coalesce(reduce(lambda c, k: c.when(f["op"] == k, tests[k]), tests, F.when(F.lit(False), F.lit(False))), F.lit(False))

    return filters.isNull() | F.forall(filters, test)


def bounds(filters: Column) -> tuple[dict[str, Column], Column]:
    """What `passes` asks in columns that are worked out once for a query: for each statistic the largest value that it must exceed (gt) or reach (ge) and the smallest
    that it must stay under (lt) or at (le); and the test of a pair by these. Other tests than of order stay in an array, null where there are none."""
    of = lambda *ops: lambda x: x["op"].isin(*ops)
    orders = {"gt": (">",), "ge": (">=", "="), "lt": ("<",), "le": ("<=", "=")}
    tame = lambda x: F.coalesce(x["field"].isin(*STATISTICS) & x["op"].isin(*(o for ops in orders.values() for o in ops)) & x["value"].isNotNull(), F.lit(False))
    columns, tests = {}, []
    for field in STATISTICS:
        for name, ops in orders.items():
            values = F.transform(F.filter(filters, lambda x: tame(x) & (x["field"] == field) & of(*ops)(x)), lambda x: x["value"].cast("double"))
            columns[f"_{field}_{name}"] = (F.array_max if name in ("gt", "ge") else F.array_min)(values)
            bound, v = F.col(f"_{field}_{name}"), F.col(field).cast("double")
            tests.append(bound.isNull() | F.coalesce({"gt": v > bound, "ge": v >= bound, "lt": v < bound, "le": v <= bound}[name], F.lit(False)))
    rest = F.filter(filters, lambda x: ~tame(x))
    columns["_rest"] = F.when(F.size(rest) > 0, rest)
    return columns, reduce(lambda a, b: a & b, tests) & passes(F.col("_rest"))


def kinds_of(queries: DataFrame, flags: dict[str, str]) -> tuple[DataFrame, Column, Column] | None:
    """Of a bulk query's tests of a feature alone, the distinct sets: the queries with _word and _bit, the place of their set; the outcomes of all sets for a feature, bits
    of an array; and the test of a pair by these. None if there are more than KINDS sets, or filters than KIND_FILTERS, and so for each pair to be tested.

    flags: for columns that name a wanted value, the feature's column. The sets are written into the expression, and so known to the driver, to which no more come than the bound.
    """
    minima = {f"min_{c}": c for c in ("samples_count", "coverage_sum") if f"min_{c}" in queries.columns}
    names = [*minima, *flags, *(["filters"] if "filters" in queries.columns else [])]
    if not names:
        return queries, F.array().cast("array<bigint>"), F.lit(True)
    some = queries.select(*(F.slice(c, 1, KIND_FILTERS + 1).alias(c) if c == "filters" else F.col(c) for c in names)).distinct().limit(KINDS + 1)
    table = stored(some.coalesce(1).withColumn("_i", F.monotonically_increasing_id()))  # numbered from 0 on
    rows = sorted(table.collect(), key=lambda r: r["_i"])
    if len(rows) > KINDS or sum(len(r.filters or ()) for r in rows if "filters" in names) > KIND_FILTERS:
        return None

    def test(row):
        asked = [F.col(c) >= F.lit(row[m]) for m, c in minima.items() if row[m] is not None] + [F.col(c) == F.lit(row[w]) for w, c in flags.items() if row[w] is not None]
        for f in (row["filters"] if "filters" in names else None) or ():
            if f is None or f["field"] not in STATISTICS or f["op"] not in ("=", "!=", "<", "<=", ">", ">=") or f["value"] is None:
                return F.lit(False)
            left, right = F.col(f["field"]).cast("double"), F.lit(float(f["value"]))
            asked.append({"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[f["op"]])
        return F.coalesce(reduce(lambda a, b: a & b, asked), F.lit(False)) if asked else F.lit(True)

    bits = [F.when(test(r), F.lit(1 << i % KIND_BITS).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rows)]
    words = [reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + KIND_BITS]) for i in range(0, len(bits), KIND_BITS)]
    places = ((F.col("_i") / KIND_BITS).cast("int").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_i") % KIND_BITS).cast("int")).alias("_bit"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names))
    placed = queries.join(F.broadcast(table.select(*(F.col(c).alias(f"_k_{c}") for c in names), *places)), same).drop(*(f"_k_{c}" for c in names))
    return placed, F.array(*words).cast("array<bigint>"), F.get("_kinds", F.col("_word")).bitwiseAND(F.col("_bit")) != 0


def hash_tables(lists: DataFrame) -> DataFrame:
    """_list and `table` for each list of ids (_list, sids): an array of as many small arrays as there are ids, in which an id lies at its hash.

    Whether a list has an id is so told in constant time, whatever its length, by a column expression (`has_id`). Null ids are passed over; an empty list has one empty array.
    """
    sized = lists.select("_list", F.array_distinct(F.filter("sids", lambda s: s.isNotNull())).alias("ids")).withColumn("n", F.greatest(F.size("ids"), F.lit(1)))
    ids = sized.select("_list", "n", F.explode("ids").alias("sid")).select("_list", slot("sid", "n").alias("slot"), "sid")
    slots = sized.select("_list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    filled = slots.join(ids.groupBy("_list", "slot").agg(F.collect_list("sid").alias("ids")), ["_list", "slot"], "left").select("_list", "slot", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    return filled.groupBy("_list").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("slots")).select("_list", F.col("slots.ids").alias("table"))


def slot(sid: Column | str, n: Column | str) -> Column:
    return F.pmod(F.xxhash64(sid), n).cast("int")


def has_id(table: Column, sid: Column) -> Column:
    return F.coalesce(F.array_contains(F.get(table, slot(sid, F.size(table))), sid), F.lit(False))


def restrict_by_list(own: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row of `own` for each of its lists, with the entries of the list's samples and statistics of these; rows without any are left out.

    own: samples, and _row, a number that no other row has; pairs: _row and _list; members: _list and sid. All three are written tables, members without nulls and
    each once. Lists of up to IN_ROW_IDS ids come into the row as a hash table. Of longer ones no row gets a copy: entries ask for their sample, dealt out by rows,
    about ENTRIES of them to a task, and stay there until they are gathered again.
    """
    longest = members.groupBy("_list").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    few = members.count() <= BROADCAST_IDS
    if longest <= IN_ROW_IDS:
        tables = stored(hash_tables(members.groupBy("_list").agg(F.collect_list("sid").alias("sids"))))
        rows = own.join(pairs.hint("merge"), "_row").join(F.broadcast(tables) if few else tables, "_list")
        rows = rows.withColumn("_kept", F.explode(F.array(F.filter("samples", lambda s: has_id(F.col("table"), s["sid"]))))).where(F.size("_kept") > 0).drop("samples", "table").withColumnRenamed("_kept", "samples")
    else:
        each = own.agg(F.coalesce(F.avg(F.size("samples")), F.lit(0))).first()[0]
        n = max(1, int(pairs.count() * each / ENTRIES) + 1)
        entries = own.select("_row", "samples").repartition(n, "_row").join(pairs.repartition(n, "_row").hint("merge"), "_row")
        entries = entries.select("_row", "_list", F.posexplode("samples").alias("pos", "entry")).select("_row", "_list", "pos", "entry.sid", "entry.cov").join(F.broadcast(members) if few else members, ["_list", "sid"], "left_semi")
        lists = entries.groupBy("_row", "_list").agg(F.array_sort(F.collect_list(F.struct("pos", "sid", "cov"))).alias("_kept"))
        rows = own.drop("samples").repartition(n, "_row").join(lists.hint("merge"), "_row").withColumn("samples", F.transform("_kept", lambda e: F.struct(e["sid"].alias("sid"), e["cov"].alias("cov")))).drop("_kept")
    return rows.withColumns(summary("samples"))


def bulk_query(df: DataFrame, queries: DataFrame, width: int = BIN, lists: DataFrame | None = None) -> DataFrame:
    """Many labelled queries in one interval join, each with its own filters.

    queries: label, b_chrom, b_start, b_end and any of mode, min_samples_count, min_coverage_sum, filters (array of field, op, value), strand_wanted,
    annotated_wanted, left_wanted, right_wanted (booleans), sids (array of long, such as a metadata search gives); a null asks nothing, an empty sids finds
    nothing. With sids, statistics and their filters are those of these samples. lists: list and sid, a row for each sample of a list; queries then name theirs in a
    column list instead of sids, so that none carries it whole; a list without a row finds nothing.
    Rows meet queries in the bins of the join and nowhere else: a pair is tested and given out where it is made, never shuffled. With sids a feature is restricted
    once for each distinct list that a query near it has, before the join, and then meets the queries of that list only; what a pair carries of a list is its hash.
    Tests of a feature alone are made before the join, once for each distinct set of them (`kinds_of`), so that of a pair only a bit is asked.
    """
    has = set(queries.columns)
    named = {c: f"b_{c}" if c in df.columns else c for c in queries.columns}
    flags = {"strand_wanted": "strand", "annotated_wanted": "annotated"} | {f"{s}_wanted": f"_{s}" for s in ("left", "right")}
    own = df.withColumns({f"_{s}": F.size(f"{s}_sources") > 0 for s in ("left", "right") if f"{s}_wanted" in has})
    asked, conditions = queries, []
    if "mode" in has:
        columns, test = mode_flags(F.col("mode"))
        asked, conditions = asked.withColumns(columns), [test]
    kinds = kinds_of(asked, {k: v for k, v in flags.items() if k in has})
    if kinds is not None:
        asked, outcomes, test = kinds
        conditions.append(test)
    else:
        conditions += [F.col(k).isNull() | (F.col(v) == F.col(k)) for k, v in flags.items() if k in has]
        conditions += [F.col(f"min_{c}").isNull() | (F.col(c) >= F.col(f"min_{c}")) for c in ("samples_count", "coverage_sum") if f"min_{c}" in has]
        if "filters" in has:
            columns, test = bounds(F.col("filters"))
            asked = asked.withColumns(columns)
            conditions.append(test)
    if "sids" in has or lists is not None:
        if lists is not None:
            asked = asked.withColumn("_list", F.col("list"))
            members = lists.select(F.col("list").alias("_list"), F.col("sid").cast("long").alias("sid"))
        else:
            known = F.col("sids").isNotNull()
            asked = asked.withColumns({"_list": F.when(known, F.xxhash64(F.array_sort(F.array_distinct("sids")), F.size("sids"))), "_ids": F.when(known, F.xxhash64("sids"))})
            members = asked.where("_list is not null").groupBy("_list").agg(F.first("sids").alias("sids")).select("_list", F.explode("sids").alias("sid"))
            raw = asked.where("_ids is not null").groupBy("_ids").agg(F.first("sids").alias(named["sids"]))
            asked = asked.drop("sids")
        members = stored(members.where("_list is not null and sid is not null").distinct())
        own = stored(own.withColumn("_row", F.monotonically_increasing_id()))
        levels = levels_of(own, width)
        near = merged(asked.where("_list is not null").select("b_chrom", "b_start", "b_end", "_list"), ["_list"])
        wanted = overlap_join(own.select("chrom", "start", "end").distinct(), near, width, levels=levels).select("chrom", "start", "end", "_list").distinct()
        pairs = stored(own.select("_row", "chrom", "start", "end").join(wanted.hint("merge"), ["chrom", "start", "end"]).select("_row", "_list"))
        whole = own.withColumn("_list", F.lit(None).cast(pairs.schema["_list"].dataType))
        own = restrict_by_list(own, pairs, members)
        if not asked.where("_list is null").isEmpty():
            own = own.unionByName(whole)
        conditions.append(F.col("_list").eqNullSafe(F.col("b__list")))
    else:
        levels = levels_of(df, width)
    if kinds is not None:
        own = own.withColumn("_kinds", outcomes)
    out = overlap_join(own, asked, width, reduce(lambda a, b: a & b, conditions) if conditions else None, levels)
    if "sids" in has and lists is None:
        out = out.join(raw, "_ids", "left")
    return out.select(*df.columns, *named.values())
