"""Aggregations: of features, of samples, of base coverage, of groups and studies; type inference; merging of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import summary
from spanlake.operators.intervals import STRETCH, clip_to_bins, overlap_join
from spanlake.scratch import stored


def feature_stats(df: DataFrame, digits: int | None = None) -> DataFrame:
    """The four statistics from the sample list, in the row; digits: places that mean and median are rounded to."""
    found = summary("samples")
    if digits is not None:
        found |= {k: F.round(found[k], digits) for k in ("coverage_avg", "coverage_median")}
    return df.withColumns(found)


def long_stats(entries: DataFrame, key: str = "feature_id", value: str = "cov", spread: bool = False) -> DataFrame:
    """The same from long form. spread: for keys that may hold a large share of all rows; the median then comes from `medians`, and no task holds a key's values."""
    v = F.col(value)
    sums = [F.count(v).alias("samples_count"), F.sum(v).alias("coverage_sum"), F.avg(v).alias("coverage_avg")]
    if not spread:
        return entries.groupBy(key).agg(*sums, F.median(v).alias("coverage_median"))
    return entries.groupBy(key).agg(*sums).join(medians(entries, key, value).select(F.col(key).alias("_key"), F.col("median").alias("coverage_median")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


#: Quantiles of all values between which the values of a key are divided.
MEDIAN_BLOCKS = 256


def medians(entries: DataFrame, key: str, value: str) -> DataFrame:
    """key and median of its values (of two middle ones the mean), exact however the rows are dealt to keys; null values don't count, and a null key is a key.

    Equal values of a key are counted before they move. Values are divided by quantiles of all values; how many of a key's lie before each division tells
    in which one or two its middle lies, and only these are put in order: a key's values are never in one task, nor in one place.
    """
    v = F.col(value)
    counts = stored(entries.where(v.isNotNull()).groupBy(F.col(key).alias("_k"), v.cast("double").alias("v")).agg(F.count("*").alias("n")))
    cuts = counts.agg(F.percentile_approx("v", [k / MEDIAN_BLOCKS for k in range(1, MEDIAN_BLOCKS)]).alias("cuts"))
    dealt = counts.join(F.broadcast(cuts)).withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
    of_key = Window.partitionBy("_k")
    blocks = dealt.groupBy("_k", "block").agg(F.sum("n").alias("size"))  # MEDIAN_BLOCKS rows a key at most
    blocks = blocks.withColumns({"all": F.sum("size").over(of_key), "before": F.coalesce(F.sum("size").over(of_key.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1  # ranks of the middle
    middle = blocks.withColumns({"low": low, "high": high}).where("before < high and before + size >= low").select(F.col("_k").alias("_key"), F.col("block").alias("_block"), "before", "low", "high")
    near = dealt.join(middle, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    rank = F.col("before") + F.sum("n").over(Window.partitionBy("_k", "block").orderBy("v"))
    found = near.withColumn("rank", rank).groupBy("_k").agg(F.min(F.when(F.col("rank") >= F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("rank") >= F.col("high"), F.col("v"))).alias("b"))
    return found.select(F.col("_k").alias(key), ((F.col("a") + F.col("b")) / 2).alias("median"))


def sample_stats(entries: DataFrame, samples: DataFrame, sid: str = "sid") -> DataFrame:
    """Metadata with each sample's number of features, coverage and mean coverage; zeros where there are none."""
    counted = entries.groupBy("sid").agg(F.count("*").alias("n_features"), F.sum("cov").alias("coverage"), F.avg("cov").alias("mean_coverage")).withColumnRenamed("sid", sid)
    out = samples.join(counted, sid, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_features", "coverage")} | {"mean_coverage": F.coalesce("mean_coverage", F.lit(0.0))})


def bases_by_row(bases: DataFrame, n_samples: int | Column, op: str = "sum") -> DataFrame:
    """One value a base row, over samples. A mean divides by all samples, those without a value included."""
    total = F.sum("value")
    return bases.groupBy("chrom", "start", "end").agg((total if op == "sum" else total / n_samples).alias("value"))


def bases_by_sample(bases: DataFrame, label: str, op: str = "sum") -> DataFrame:
    """One value a sample, over rows, labelled. A mean divides by all distinct rows of the input."""
    rows = bases.agg(F.countDistinct("chrom", "start", "end").alias("n_rows"))
    sums = bases.groupBy("sid").agg(F.sum("value").alias("total"))
    return sums.join(F.broadcast(rows)).select(F.lit(label).alias("label"), "sid", (F.col("total") if op == "sum" else F.col("total") / F.col("n_rows")).alias("value"))


def bases_summary(bases: DataFrame, threshold: float = 501) -> DataFrame:
    """Sum, sum per base and number of samples at or over the threshold, of each base row. A row of no bases (start = end) has a null sum per base."""
    width = F.nullif(F.col("end") - F.col("start"), F.lit(0))
    return bases.groupBy("chrom", "start", "end").agg(F.sum("value").alias("total"), F.count_if(F.col("value") >= threshold).alias("n_over")).withColumn("per_base", F.col("total") / width)


def dense_values(entries: Column, n: Column | int) -> Column:
    """An array of n numbers from a sorted array of (at, value): 0 where nothing is. Written gap by gap, so its cost is that of the array."""
    n = F.lit(n) if isinstance(n, int) else n
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    before = lambda i: F.coalesce(F.get(entries, i - 1)["at"], F.lit(-1))
    filled = F.flatten(F.transform(entries, lambda x, i: F.concat(zeros(x["at"] - before(i) - 1), F.array(x["value"]))))
    return F.concat(filled, zeros(n - 1 - F.coalesce(F.try_element_at(entries, F.lit(-1))["at"], F.lit(-1))))


def base_rows(bases: DataFrame, wanted: DataFrame, n: int | None = None) -> DataFrame:
    """Base rows with one array of values, those of the wanted samples in their order, 0 where a sample has none: chrom, start, end, values.

    wanted: at (0 and up, without holes) and sid, which may come several times; n: how many. A row without a value of any wanted sample stays away. However
    many samples there are, the plan is the same; a row takes as much memory as its array.
    """
    n = n if n is not None else wanted.count()
    found = bases.join(wanted.select("at", "sid"), "sid").groupBy("chrom", "start", "end", "at").agg(F.max("value").alias("value"))
    rows = found.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_e"))
    return rows.select("chrom", "start", "end", dense_values(F.col("_e"), n).alias("values"))


def base_columns(bases: DataFrame, sids: list[int] = (), groups: dict[str, list[int]] | None = None) -> DataFrame:
    """Base rows with a column for each wanted sample, 0 where it has no value: s<sid> by ids, <group>_s<sid> by named groups.

    A row without a value of any wanted sample stays away. An empty choice gives the coordinates alone. Columns are taken from `base_rows`; for thousands of samples use its arrays.
    """
    named = [(f"s{s}", s) for s in sids] + [(f"{name}_s{s}", s) for name, members in (groups or {}).items() for s in members]
    if not named:
        return bases.select("chrom", "start", "end").distinct()
    wanted = bases.sparkSession.createDataFrame([(i, int(s)) for i, (_, s) in enumerate(named)], "at long, sid long")
    return base_rows(bases, wanted, len(named)).select("chrom", "start", "end", *(F.col("values")[i].alias(name) for i, (name, _) in enumerate(named)))


def base_query(bases: DataFrame, region: tuple[str, int, int], sids: list[int] | DataFrame | None = None, op: str | None = None, by: str = "row", label: str | None = None, n_samples: int | None = None) -> DataFrame:
    """Base rows (0-based, half-open) that a closed, 1-based region touches, as the wanted samples have them.

    sids: a list, or a table (first column) such as the members of named groups; None takes all. op None gives long rows (chrom, start, end, sid, value);
    sum or mean gives one value a row (by row; a mean divides by the wanted samples, whose number a table or n_samples tells) or a sample (by sample; it
    divides by the region's distinct rows), with the label. A region without rows gives none.
    """
    chrom, start, end = region
    own = bases.where((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") < end))
    if isinstance(sids, DataFrame):
        wanted = sids.select(F.col(sids.columns[0]).cast("long").alias("sid")).distinct()
        own, n_samples = own.join(wanted, "sid", "left_semi"), n_samples or wanted.count()
    elif sids is not None:
        own, n_samples = own.where(F.col("sid").isin([int(s) for s in sids])), n_samples or len(set(sids))
    if op is None:
        return own.select("chrom", "start", "end", "sid", "value")
    if by == "sample":
        return bases_by_sample(own, label or f"{chrom}:{start}-{end}", op)
    if op == "mean" and not n_samples:
        raise ValueError("a mean over samples needs their number")
    return bases_by_row(own, n_samples or 1, op).withColumn("label", F.lit(label or f"{chrom}:{start}-{end}"))


def base_query_by_splits(bases: DataFrame, region: tuple[str, int, int], width: int, op: str = "sum", by: str = "row", label: str = "", n_samples: int | None = None) -> DataFrame:
    """A base query cut at the borders of bins of `width` bases, with a labelled row for each split: chrom|start|end|label.

    by row: a value for each base row of a split (a row over a border belongs to both), a mean over n_samples; by sample: a value for each sample of a split, a
    mean over the split's distinct rows. Splits without rows give none.
    """
    chrom, start, end = region
    splits = clip_to_bins(bases.sparkSession.createDataFrame([(chrom, int(start), int(end))], "chrom string, start long, end long"), width)
    named = splits.select(F.col("chrom").alias("b_chrom"), F.col("clip_start").alias("b_start"), F.col("clip_end").alias("b_end"), F.concat_ws("|", "chrom", "clip_start", "clip_end", F.lit(label)).alias("label"))
    closed = bases.where((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") < end)).withColumn("_zero", F.col("start")).withColumn("start", F.col("start") + 1)
    own = overlap_join(closed, named, width).select("label", "chrom", F.col("_zero").alias("start"), "end", "sid", "value")
    if by == "row":
        if op == "mean" and not n_samples:
            raise ValueError("a mean over samples needs their number")
        return own.groupBy("label", "chrom", "start", "end").agg((F.sum("value") / (n_samples if op == "mean" else 1)).alias("value"))
    rows = own.groupBy("label").agg(F.countDistinct("start", "end").alias("_n"))
    sums = own.groupBy("label", "sid").agg(F.sum("value").alias("value"))
    return sums.join(rows, "label").select("label", "sid", (F.col("value") / F.col("_n") if op == "mean" else F.col("value")).alias("value"))


def interval_sums(bases: DataFrame, intervals: DataFrame, width: int = STRETCH) -> DataFrame:
    """Sums of base rows (0-based, half-open) over named intervals (label, b_chrom, b_start, b_end; a label may have several): label, sid, chrom, start + 1, end, length and value.

    A row that an interval covers in part counts whole, once for each interval of a label, and start and end are those of the rows. Intervals aren't joined with the rows they hold:
    along each sample's chromosome, what begins up to an interval's end less what ends before its start is its sum, so an interval costs two look-ups in running
    sums whatever its length. Sums run within stretches; a table with a row for each stretch tells what lies before it. As differences of running sums, values are exact
    as long as the running sums are.
    """
    rows = bases.select("sid", "chrom", (F.col("start") + 1).alias("start"), "end", F.col("value").cast("double").alias("value"))
    named = intervals.where("b_start <= b_end").groupBy("label", F.col("b_chrom").alias("chrom"), "b_start", "b_end").agg(F.count("*").alias("times"))
    asked = named.join(rows.select("sid", "chrom").distinct(), "chrom")
    query = ("label", "b_start", "b_end", "times")
    none = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in query]

    def events(at_row: str, at_query: str, far: str, rows_first: bool) -> DataFrame:
        own = rows.select("sid", "chrom", F.col(at_row).alias("at"), F.lit(0 if rows_first else 1).alias("kind"), "value", F.lit(1).alias("n"), F.col(far).alias("far"), *none)
        return own.unionByName(asked.select("sid", "chrom", F.col(at_query).alias("at"), F.lit(1 if rows_first else 0).alias("kind"), F.lit(0.0).alias("value"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("far"), *query))

    up = _running(events("start", "b_end", "end", True), {"value": F.sum, "n": F.sum, "far": F.max}, width)
    ended = events("end", "b_start", "start", False)
    down, back = _running(ended, {"value": F.sum, "n": F.sum}, width), _running(ended, {"far": F.min}, width, back=True)
    keys = ["sid", "chrom", *query]
    both = up.join(down.withColumnsRenamed({"value": "_value", "n": "_n"}), keys).join(back.withColumnRenamed("far", "_far"), keys).where("n > _n")
    out = both.groupBy("label", "sid", "chrom").agg(F.min("_far").alias("start"), F.max("far").alias("end"), F.sum((F.col("value") - F.col("_value")) * F.col("times")).alias("value"))
    return out.withColumn("length", F.col("end") - F.col("start") + 1)


def _running(events: DataFrame, measures: dict, width: int, back: bool = False) -> DataFrame:
    """The queries among the events (sid, chrom, at, kind, label of queries only, measures), with each measure over all events up to them (back: from them on) in order of at and kind."""
    keys = ["sid", "chrom", "_at"]
    way = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    own = events.withColumn("_at", F.floor(F.col("at") / width))
    within = Window.partitionBy(*keys).orderBy(way("at"), way("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("sid", "chrom").orderBy(way("_at")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = own.groupBy(*keys).agg(*(f(m).alias(m) for m, f in measures.items())).select(*keys, *(f(m).over(earlier).alias(f"_before_{m}") for m, f in measures.items()))
    told = own.withColumns({f"_{m}": f(m).over(within) for m, f in measures.items()}).where("label is not null").join(stretches, keys)
    joined = {m: {F.max: F.greatest, F.min: F.least}[f](f"_{m}", f"_before_{m}") if f in (F.max, F.min) else F.col(f"_{m}") + F.coalesce(f"_before_{m}", F.lit(0)) for m, f in measures.items()}
    return told.select("sid", "chrom", "label", "b_start", "b_end", "times", *(c.alias(m) for m, c in joined.items()))


def rollup_key(df: DataFrame, key: str, part: int, delimiter: str, values: list[str]) -> DataFrame:
    """Rows summed by one part of a delimited key: length, first start, last end and the values."""
    return df.groupBy(F.split_part(F.col(key), F.lit(delimiter), F.lit(part)).alias("part")).agg(F.sum("length").alias("length"), F.min("start").alias("start"), F.max("end").alias("end"), *(F.sum(v).alias(v) for v in values))


def exon_to_gene(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts by row ordinal and sample, summed by the gene of the ordinal."""
    return counts.join(mapping, "ordinal").groupBy("gene", "sid").agg(F.sum("cov").alias("cov"))


def sparse_from_wide(wide: DataFrame, keys: list[str], ids: DataFrame, truncate: bool = False) -> DataFrame:
    """Sample lists from a column for each sample: header accessions become ids (accession, sid; case doesn't matter), zeros and unknown samples go."""
    columns = [c for c in wide.columns if c not in keys]
    entries = wide.unpivot(keys, columns, "accession", "value").where("value > 0")
    known = ids.select(F.upper("accession").alias("_up"), "sid")
    value = F.col("value").cast("long") if truncate else F.col("value")
    found = entries.join(known, F.upper("accession") == F.col("_up")).withColumn("cov", value)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sid", "cov"))).alias("samples"))


def group_means(entries: DataFrame, groups: DataFrame, names: list[str], key: str = "gene") -> DataFrame:
    """A column for each group: the mean over all its members, those without an entry as 0, then its natural logarithm where that is 1 at least, else 0,
    to one decimal. groups: sid, group of every sample of the table. A key without any member's entry has zeros; a group without members too.
    """
    sizes = {r.group: r.n for r in groups.where(F.col("group").isin(names)).groupBy("group").agg(F.countDistinct("sid").alias("n")).collect()}  # a row for each name at most
    sums = entries.join(groups, "sid", "left").groupBy(key).pivot("group", sorted(names)).agg(F.sum("cov"))
    mean = lambda n: F.col(f"`{n}`") / max(1, sizes.get(n, 0))
    return sums.select(key, *(F.when(mean(n) >= 1, F.round(F.ln(mean(n)), 1)).otherwise(F.lit(0.0)).alias(n) for n in sorted(names)))


def normalised_by_parent(entries: DataFrame, parents: DataFrame, key: str = "feature_id") -> DataFrame:
    """Coverage of each feature in each parent (study or biological sample), over the parent's size. parents: sid, parent."""
    sizes = parents.groupBy("parent").agg(F.countDistinct("sid").alias("size"))
    sums = entries.join(parents, "sid").groupBy(key, "parent").agg(F.sum("cov").alias("coverage"))
    return sums.join(sizes, "parent").select(key, "parent", (F.col("coverage") / F.col("size")).alias("value"))


def feature_studies(entries: DataFrame, studies: DataFrame, key: str = "feature_id") -> DataFrame:
    """For each feature its studies by share of samples, then coverage: whole percentages of both, a study of 0 % of samples left out, and the rank.
    A feature without any coverage has 0 % of it in each study."""
    sums = entries.join(studies, "sid").groupBy(key, "study").agg(F.count("*").alias("n"), F.sum("cov").alias("c"))
    w = Window.partitionBy(key)
    share = lambda x: F.coalesce(F.floor(F.col(x) * 100 / F.nullif(F.sum(x).over(w), F.lit(0))), F.lit(0)).cast("int")
    both = sums.select(key, "study", share("n").alias("samples_percent"), share("c").alias("coverage_percent")).where("samples_percent > 0")
    return both.withColumn("rank", F.row_number().over(w.orderBy(F.desc("samples_percent"), F.desc("coverage_percent"), "study")))


#: What counts as an integer, a fraction and nothing.
TYPES = {"i": r"^-?[0-9]+$", "f": r"^-?[0-9]+\.?[0-9]+$|e\+", "n": r"^\s*$|^NA$"}


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, type) of text columns: i, f or t by the most frequent kind of value. Once a fraction occurs, integers don't count: f and t compete.
    Empty values count for nothing; a column of these alone, or of no rows, is n. t wins a draw.
    """
    values = df.unpivot([], columns, "field", "value")
    v = F.col("value")
    kind = F.when(v.isNull() | v.rlike(TYPES["n"]), "n").when(v.rlike(TYPES["i"]), "i").when(v.rlike(TYPES["f"]), "f").otherwise("t")
    n = values.groupBy("field").agg(*(F.count_if(kind == k).alias(k) for k in "iftn"))
    best = F.when((F.col("f") > 0) & (F.col("f") > F.col("t")), "f").when((F.col("f") == 0) & (F.col("i") > F.col("t")), "i").when(F.col("f") + F.col("i") + F.col("t") > 0, "t").otherwise("n")
    fields = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    return fields.join(n.select("field", best.alias("type")), "field", "left").select("field", F.coalesce("type", F.lit("n")).alias("type"))


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast as inferred; what can't be cast is null."""
    to = {"i": "bigint", "f": "double"}
    return df.select(*(F.expr(f"try_cast(`{c}` AS {to[types[c]]})").alias(c) if types.get(c) in to else F.col(c) for c in df.columns))


def build_groups(samples: DataFrame, name: Column, sid: str = "rail_id", code: Column | None = None, run: Column | None = None) -> DataFrame:
    """Groups by name, with _normal or _tumor by a numeric code (10 and more is normal): group, long name, members in order and their number.

    A group's name is the given one without TCGA- and CCLE-, with _ for each blank, its case as it is. run: names of runs, of which only first replicates (ending
    in .1) are taken. A sample without a name is in the group NA.
    """
    if run is not None:
        samples = samples.where(run.rlike(r"\.1$"))
    cleaned = F.replace(F.replace(F.replace(name, F.lit("TCGA-"), F.lit("")), F.lit("CCLE-"), F.lit("")), F.lit(" "), F.lit("_"))
    if code is not None:
        cleaned = F.concat(cleaned, F.when(code >= 10, F.lit("_normal")).otherwise(F.lit("_tumor")))
    return samples.select(F.when(F.coalesce(cleaned, F.lit("")) == "", "NA").otherwise(cleaned).alias("group"), name.alias("long_name"), F.col(sid).alias("sid")).groupBy("group").agg(F.min("long_name").alias("long_name"), F.count("*").alias("n"), F.array_sort(F.collect_list("sid")).alias("sids"))


def merge_runs(entries: DataFrame, accessions: DataFrame, step: int) -> DataFrame:
    """Features of several runs merged on their coordinates.

    entries: run, chrom, start, end, strand, sid, cov. accessions: run, sid, accession. Ids become run * step + sid; an accession that
    occurs again takes its smallest id. The strand is that of the first run, and lists are sorted by id.
    """
    own = F.col("run") * step + F.col("sid")
    first = accessions.groupBy("accession").agg(F.min(own).alias("first"))
    ids = accessions.join(first, "accession").select("run", "sid", "first")
    moved = entries.join(ids, ["run", "sid"], "left").withColumn("sid", F.coalesce("first", own))
    return moved.groupBy("chrom", "start", "end").agg(F.min_by("strand", "run").alias("strand"), F.array_sort(F.collect_list(F.struct("sid", "cov"))).alias("samples"))


def table_summary(df: DataFrame) -> DataFrame:
    """One row: features, entries of their lists, and the mean number of entries; an empty table has 0, null and null."""
    return df.agg(F.count("*").alias("n_features"), F.sum("samples_count").alias("n_entries"), F.avg("samples_count").alias("mean_samples"))


def dense_ids_of(df: DataFrame, column: str) -> DataFrame:
    """0-based ids of the sorted distinct values of a column, and how many rows have each.

    Values are dealt out by ranges, written, and numbered within a range; only the table of ranges is summed up as a whole.
    """
    dealt = stored(df.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.withColumn("_own", own).join(F.broadcast(ranges), "_range").select(column, "n", (F.col("_before") + F.col("_own") - 1).cast("int").alias("id"))


def report(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by keys, the largest first: ordered by the measures in turn, descending with nulls last, then by the keys."""
    out = df.groupBy(*keys).agg(*(c.alias(name) for name, c in measures.items()))
    return out.orderBy(*(F.desc_nulls_last(name) for name in measures), *keys)


def studies_in_order(entries: DataFrame, studies: DataFrame, key: str = "feature_id") -> DataFrame:
    """For each feature its studies in one list, by number of samples, then coverage, both descending, then name. entries: key, sid, cov; studies: sid, study."""
    sums = entries.join(studies, "sid").groupBy(key, "study").agg(F.count("*").alias("n"), F.sum("cov").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("c")).alias("c"), "study")))  # a study once
    return sums.groupBy(key).agg(F.transform(ordered, lambda x: x["study"]).alias("studies"))


def top_values(df: DataFrame, column: str) -> DataFrame:
    """How many rows each value of the column has, the most frequent first, ties by value; null is a value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def features_from_raw(raw: DataFrame) -> DataFrame:
    """Raw rows (chrom, strand, start, end, sids, covs) as features: zero coverages go, and rows without any; length and statistics are added."""
    pairs = F.filter(F.arrays_zip(F.col("sids").alias("sid"), F.col("covs").alias("cov")), lambda s: s["cov"] > 0)
    named = F.transform(pairs, lambda s: F.struct(s["sid"].alias("sid"), s["cov"].alias("cov")))
    out = raw.withColumn("samples", named).where(F.size("samples") > 0).withColumn("length", F.col("end") - F.col("start") + 1)
    return feature_stats(out.drop("sids", "covs"))


def coverage_matrix(bases: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """chrom, start, end and values: of all samples in order of sid, or of those of a table (first column), to one decimal, 0 where a sample has none.

    Samples are numbered by ranges (`dense_ids_of`), so neither their ids nor a column for each pass through the driver or the plan.
    """
    sids = (bases if samples is None else samples).select(F.col("sid" if samples is None else samples.columns[0]).alias("sid"))
    wanted = stored(dense_ids_of(sids, "sid").select(F.col("id").cast("long").alias("at"), "sid"))
    return base_rows(bases, wanted).withColumn("values", F.transform("values", lambda x: F.round(x, 1)))


def normalise_auc(entries: DataFrame, auc: DataFrame, target: float = 40e6) -> DataFrame:
    """Counts scaled to a common area under coverage, rounded half to even; an area of 0 gives 0. auc: sid, auc."""
    scaled = F.bround(F.lit(target) * F.col("cov") / F.when(F.col("auc") == 0, 1).otherwise(F.col("auc")), 0).cast("long")
    return entries.join(auc, "sid").withColumn("norm", F.when(F.col("auc") == 0, 0).otherwise(scaled)).drop("auc")


def normalise_jxcov(entries: DataFrame, mean: float | None = None) -> DataFrame:
    """Counts over their sample's total times the mean total, or a given one; a sample without coverage has 0."""
    totals = entries.groupBy("sid").agg(F.sum("cov").alias("total"))
    target = totals.agg(F.avg("total").alias("target")) if mean is None else entries.sparkSession.range(1).select(F.lit(mean).alias("target"))
    return entries.join(totals, "sid").join(F.broadcast(target)).withColumn("norm", F.coalesce(F.bround(F.col("cov") / F.nullif(F.col("total"), F.lit(0)) * F.col("target"), 0).cast("long"), F.lit(0))).drop("total", "target")


def restat_nonzero(entries: DataFrame, key: str = "feature_id", value: str = "norm") -> DataFrame:
    """Statistics of each key from its values over 0; keys without any stay away."""
    return long_stats(entries.where(F.col(value) > 0), key, value)


def skip_zero_rows(entries: DataFrame, key: str = "feature_id", value: str = "norm") -> DataFrame:
    """Entries of the rows that have any value but zero."""
    return entries.join(entries.where(F.col(value) > 0).select(key).distinct(), key, "left_semi")


def eligible_samples(samples: DataFrame, flag: str, auc: str) -> DataFrame:
    """sid and auc of the samples whose flag is true."""
    return samples.where(F.col(flag)).select("sid", F.col(auc).alias("auc"))

