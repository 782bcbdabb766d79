"""Interval joins on binned coordinates, and orders along a chromosome.

Coordinates are 1-based and closed unless said otherwise. A join of intervals deals both sides out by (chromosome, level, bin). The left side's
intervals go to the level whose bins are as wide as they are long, where they touch two bins at most; the right side's go to their bins on every level. An
overlapping pair meets in every bin they share and counts in the first of these only, so no distinct is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.scratch import stored

#: Bases of a bin: near the usual length of the shorter side, so that most of its intervals fall in one or two.
BIN = 1000
#: Levels of bins, each this many times as wide as the one before; what is longer than the widest bin is dealt to all that it touches.
LEVELS, FACTOR = 6, 8
#: Levels below the first, for intervals that shall hold points: their bins are narrower by FACTOR each.
FINE = 3


def binned(df: DataFrame, start: str = "start", end: str = "end", width: int = BIN, name: str = "bin") -> DataFrame:
    """A row for each bin that the interval touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def level_of(size: Column, width: int = BIN, low: int = 0) -> Column:
    """The level whose bins are as wide as an interval of that size is long, from level `low` on."""
    return reduce(lambda c, k: c.when(size <= max(1, int(width * FACTOR**k)), k), range(low, LEVELS), F.when(F.lit(False), 0)).otherwise(LEVELS - 1)


def bases_of(level: Column, width: int = BIN) -> Column:
    """Bases of a level's bins."""
    return F.greatest(F.lit(1), F.floor(F.lit(width) * F.pow(F.lit(float(FACTOR)), level)))


#: Levels of bins that ranges are made of, each four times as wide as the one before, from single bases on; what is longer than the widest is made of many of these.
DEPTH = 10


def _over(x: Column, level: Column) -> Column:
    """floor(x / 4 ** level)"""
    return F.call_function("shiftright", x.cast("long"), level * 2)


def bins_of_point(at: Column) -> Column:
    """Level and bin of a point on every level."""
    return F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda k: F.struct(k.alias("level"), _over(at, k).alias("bin")))


def bins_of_range(low: Column, high: Column) -> Column:
    """Level and bin of the fewest bins that make up the closed range: they hold its points and no others, each once. Empty where high is below low."""

    def at(k):
        first, behind = lambda k: -_over(-low, k), lambda k: _over(high + 1, k)
        up, down = first(k + 1) * 4, behind(k + 1) * 4
        wider = (up < down) & (k < DEPTH - 1)  # wider bins go on between
        run = lambda x, y: F.when(x < y, F.sequence(x, F.greatest(x, y - 1))).otherwise(F.array().cast("array<bigint>"))
        both = F.concat(run(first(k), F.when(wider, up).otherwise(behind(k))), run(F.when(wider, down).otherwise(behind(k)), behind(k)))
        return F.transform(both, lambda b: F.struct(k.alias("level"), b.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), at))


def levels_of(df: DataFrame, width: int = BIN) -> list[int]:
    """The levels that the intervals of a table lie on, LEVELS at most, by one pass over its starts and ends."""
    return sorted(r.level for r in df.where("start <= end").select(level_of(F.col("end") - F.col("start") + 1, width).alias("level")).distinct().collect())


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, how: Column | None = None, levels: list[int] | None = None) -> DataFrame:
    """Pairs of overlapping rows of the same chrom. `b` names its place b_chrom, b_start, b_end; another column that `a` has too comes as b_<name>.

    how: a further condition on the pair. levels: those of `a` (`levels_of`), if they are cheaply had; `b` is then copied to no others. A place with a null or with end before start meets nothing. A row of `a` is copied twice at most, whatever
    its length, unless it is longer than width * FACTOR ** (LEVELS - 1). What a pair is tested by is worked out on either side. Sizes of files don't tell
    how many rows an explode makes of them, so nothing is left to a broadcast.
    """
    for c in b.columns:
        if c in a.columns:
            b = b.withColumnRenamed(c, f"b_{c}")
    place = lambda at, level: F.floor(F.col(at) / bases_of(F.col(level), width))
    left = a.where("start <= end").withColumn("_level", level_of(F.col("end") - F.col("start") + 1, width))
    left = left.withColumn("_bin", F.explode(F.sequence(place("start", "_level"), place("end", "_level")))).withColumn("_own", F.col("_bin") == place("start", "_level"))
    right = b.where("b_start <= b_end").withColumn("_b_level", F.explode(F.array(*map(F.lit, range(LEVELS) if levels is None else levels)).cast("array<int>")))
    right = right.withColumn("_b_bin", F.explode(F.sequence(place("b_start", "_b_level"), place("b_end", "_b_level")))).withColumn("_b_own", F.col("_b_bin") == place("b_start", "_b_level"))
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_level") == F.col("_b_level")) & (F.col("_bin") == F.col("_b_bin"))
    on = on & (F.col("end") >= F.col("b_start")) & (F.col("start") <= F.col("b_end")) & (F.col("_own") | F.col("_b_own"))  # the first bin of both is the first of either
    return left.join(right.hint("merge"), on if how is None else on & how).drop("_level", "_b_level", "_bin", "_b_bin", "_own", "_b_own")


def prefixed(df: DataFrame, *keep: str, **renamed: str) -> DataFrame:
    """chrom, start and end as b_chrom, b_start, b_end, the other columns as given: the right side of an overlap join."""
    return df.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), *keep, *(F.col(v).alias(k) for k, v in renamed.items()))


def stab_join(points: DataFrame, intervals: DataFrame, at: str, width: int = BIN) -> DataFrame:
    """Pairs of a point (column `at`) and an interval (b_chrom, b_start, b_end) that holds it.

    An interval goes to the level whose bins are as wide as it is long, down to FINE levels of narrower bins, so it is copied twice at most unless it is longer
    than the widest bin, and meets few points that it doesn't hold; a point goes to its one bin of every level. What crowds into a bin is left to adaptive skew
    joins, which can split either side.
    """
    left = points.withColumn("_level", F.explode(F.sequence(F.lit(-FINE), F.lit(LEVELS - 1)))).withColumn("_bin", F.floor(F.col(at) / bases_of(F.col("_level"), width)))
    wide = bases_of(F.col("_b_level"), width)
    right = intervals.where("b_start <= b_end").withColumn("_b_level", level_of(F.col("b_end") - F.col("b_start") + 1, width, -FINE))
    right = right.withColumn("_b_bin", F.explode(F.sequence(F.floor(F.col("b_start") / wide), F.floor(F.col("b_end") / wide))))
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_level") == F.col("_b_level")) & (F.col("_bin") == F.col("_b_bin")) & F.col(at).between(F.col("b_start"), F.col("b_end"))
    return left.join(right.hint("merge"), on).drop("_level", "_bin", "_b_level", "_b_bin")


def any_covers(df: DataFrame, intervals: DataFrame, tests: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("chrom",), width: int | None = None, points: DataFrame | None = None) -> DataFrame:
    """`df` with a boolean for each test (name: columns x, y): whether some interval (b_chrom, b_start, b_end) begins at x or before and ends at y or after.

    (end, start) asks for an overlap, (start, end) for an interval that holds the row, (at, at) for one that holds a point. keys: columns that both must
    share, of the intervals with b_ before. No pair is made: along a chromosome the furthest end so far tells. It is taken over distinct places, within stretches,
    and over the stretches before from a table with a row for each. The places are written down first, so that the plan of `df` stands in the result once, however
    many tests there are. points: rows that have all places of `df`, if these are had with less work than `df`.
    """
    width = width or STRETCH
    own = [f"_{k}" for k in keys]
    begins = intervals.where("b_start <= b_end").select(*(F.col(f"b_{k}").alias(f"_{k}") for k in keys), F.col("b_start").cast("long").alias("_at"), F.col("b_end").cast("long").alias("_reach"), F.lit(False).alias("_asked"))
    asked = [(df if points is None else points).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(x).cast("long").alias("_at"), F.lit(None).cast("long").alias("_reach"), F.lit(True).alias("_asked")) for x in sorted({x for x, _ in tests.values()})]
    marks = stored(reduce(DataFrame.unionByName, asked, begins).groupBy(*own, "_at").agg(F.max("_reach").alias("_reach"), F.bool_or("_asked").alias("_asked"))).withColumn("_stretch", F.floor(F.col("_at") / width))
    before = Window.partitionBy(*own).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = marks.groupBy(*own, "_stretch").agg(F.max("_reach").alias("_end")).select(*own, "_stretch", F.max("_end").over(before).alias("_earlier"))
    so_far = F.max("_reach").over(Window.partitionBy(*own, "_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    reach = marks.withColumn("_within", so_far).where("_asked").join(stretches.hint("merge"), [*own, "_stretch"]).select(*own, "_at", F.greatest("_within", "_earlier").alias("_reach"))
    out = df
    for name, (x, y) in tests.items():
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in keys), F.col(x) == F.col("_at"))
        out = out.join(reach.hint("merge"), on, "left").withColumn(name, F.coalesce(F.col("_reach") >= F.col(y), F.lit(False))).drop(*own, "_at", "_reach")
    return out


def merged(intervals: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Intervals (b_chrom, b_start, b_end) of equal keys that overlap or touch, as one where they begin in the same stretch: what meets one of them meets the one."""
    own = intervals.where("b_start <= b_end").groupBy("b_chrom", *keys, "b_start").agg(F.max("b_end").alias("b_end")).withColumn("_at", F.floor(F.col("b_start") / (width or STRETCH)))
    marked = islands(own, ["b_chrom", *keys, "_at"], 1, "b_start", "b_end")
    return marked.groupBy("b_chrom", *keys, "_at", "island").agg(F.min("b_start").alias("b_start"), F.max("b_end").alias("b_end")).drop("_at", "island")


def islands(df: DataFrame, keys: list[str], gap: int = 0, start: str = "start", end: str = "end", order: list[str] | None = None) -> DataFrame:
    """Column `island`: rows of a key, in order of start, that follow the furthest end so far by at most `gap` bases share a number.

    The running maximum makes the result the same for nested intervals in any input order.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: Bases of a stretch: what one task orders of a chromosome.
STRETCH = 1 << 20


def gaps(df: DataFrame, keys: tuple[str, ...] = ("chrom",), width: int = STRETCH) -> DataFrame:
    """(keys, gap_start, gap_end, gap): where nothing lies between merged intervals; gap is start - end + 1 of the neighbours.

    The furthest end so far is taken within stretches, and over the stretches before from a table with a row for each: no task sees a whole chromosome.
    """
    own = df.select(*keys, "start", "end", F.floor(F.col("start") / width).alias("_at"))
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    stretches = own.groupBy(*keys, "_at").agg(F.max("end").alias("_end")).select(*keys, "_at", F.max("_end").over(before).alias("_earlier"))
    w = Window.partitionBy(*keys, "_at").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = own.withColumn("_within", F.max("end").over(w)).join(stretches, [*keys, "_at"]).withColumn("reach", F.greatest("_within", "_earlier"))
    return reach.where(F.col("start") > F.col("reach")).select(*keys, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"), (F.col("start") - F.col("reach") + 1).alias("gap"))


def collapse_ranges(df: DataFrame, value: str, keys: tuple[str, ...] = ("chrom",), start: str = "start", end: str = "end", width: int = STRETCH) -> DataFrame:
    """Consecutive rows (by start, end, then value) with the same value as one range, from the first's start to the last's end; they needn't touch.

    Runs are made within stretches; a table with a row for each stretch tells which first runs go on from the stretch before: no task sees a whole chromosome.
    """
    own = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.col(value).alias("_v"), F.floor(F.col(start) / width).alias("_at"))
    w = Window.partitionBy(*keys, "_at").orderBy("start", "end", "_v")
    changed = F.when((F.row_number().over(w) > 1) & F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1)
    marked = own.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("start", "end", "_v")).alias("_last")
    runs = marked.groupBy(*keys, "_at", "_run").agg(F.min("start").alias("start"), last, F.first("_v").alias("_v"), F.count("*").alias("n_rows"))
    along = Window.partitionBy(*keys).orderBy("_at")
    stretches = runs.groupBy(*keys, "_at").agg(F.max("_run").alias("_n"), F.min_by("_v", "_run").alias("_first"), F.max_by(F.struct("_v"), "_run").alias("_end"))
    goes_on = F.coalesce(F.lag("_end").over(along)["_v"].eqNullSafe(F.col("_first")) & F.lag("_end").over(along).isNotNull(), F.lit(False))
    stretches = stretches.withColumn("_goes_on", goes_on).withColumn("_open", F.last(F.when((F.col("_n") > 1) | ~F.col("_goes_on"), F.struct("_at", F.col("_n").alias("_run"))), ignorenulls=True).over(along))
    stretches = stretches.select(*keys, "_at", F.when(F.col("_goes_on"), F.lag("_open").over(along)).alias("_from"))
    whole = runs.join(stretches, [*keys, "_at"]).withColumn("_id", F.when((F.col("_run") == 1) & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.struct("_at", "_run")))
    return whole.groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("_last")["end"].alias("end"), F.first("_v").alias(value), F.sum("n_rows").alias("n_rows")).drop("_id")


def unsorted_rows(df: DataFrame, keys: list[str], order: list[str], start: str = "start") -> DataFrame:
    """Rows whose start lies before the previous row's, in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(start).over(w)).where(F.col(start) < F.col("previous"))


def missing_ids(df: DataFrame, key: str) -> DataFrame:
    """Integers between the least and the largest key that no row has: the holes after each block of keys, and those between blocks."""
    ids = df.select(F.col(key).alias("id")).distinct().withColumn("block", F.floor(F.col("id") / 10_000))
    w = Window.partitionBy("block").orderBy("id")
    within = ids.select("id", F.lead("id").over(w).alias("next"))
    edges = ids.groupBy("block").agg(F.max("id").alias("id"), F.min("id").alias("low"))
    across = edges.select("id", F.lead("low").over(Window.orderBy("block")).alias("next"))  # a row for each 10,000 ids
    both = within.where("next is not null").unionByName(across.where("next is not null")).where("next > id + 1")
    pieces = both.select(F.explode(F.sequence(F.col("id") + 1, F.col("next") - 1, F.lit(1_000_000).cast("long"))).alias("low"), (F.col("next") - 1).alias("high"))  # a long hole in pieces
    return pieces.select(F.explode(F.sequence(F.col("low"), F.least(F.col("low") + 999_999, F.col("high")))).alias("id"))


def dense_ids(df: DataFrame, order: list[str], width: int = 1 << 20, chrom: str = "chrom", start: str = "start", name: str = "id") -> DataFrame:
    """0-based ids without holes in order of (chrom, start, then `order`).

    Rows are numbered within a stretch of a chromosome; a table of stretches, small whatever the rows, holds where each begins. No
    task sees more than a stretch.
    """
    marked = df.withColumn("_bin", F.floor(F.col(start) / width))
    sizes = marked.groupBy(chrom, "_bin").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(chrom, "_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(chrom, "_bin").orderBy(start, *order)
    return marked.withColumn("_rank", F.row_number().over(w)).join(offsets, [chrom, "_bin"]).withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_bin", "_rank", "_before")


def clip_to_bins(regions: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Regions cut at the borders of bins of (bin * width, (bin + 1) * width]: bin, clipped start and end."""
    cut = regions.withColumn("region_bin", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    return cut.withColumn("clip_start", F.greatest(F.col("start"), F.col("region_bin") * width + 1)).withColumn("clip_end", F.least(F.col("end"), (F.col("region_bin") + 1) * width))


def bin_intervals(df: DataFrame, width: int) -> DataFrame:
    """The bins of each interval, and whether it crosses a border."""
    crossing = F.floor((F.col("start") - 1) / width) != F.floor((F.col("end") - 1) / width)
    return clip_to_bins(df.withColumn("crosses", crossing), width).drop("clip_start", "clip_end")


def chrom_ranges(df: DataFrame, width: int) -> DataFrame:
    """Least start and largest end of the rows that start in each bin of a chromosome."""
    return df.groupBy("chrom", F.floor((F.col("start") - 1) / width).alias("region_bin")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def disjoin(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's intervals split at every border: disjoint segments that some interval covers.

    Counts of intervals that have begun and not ended, summed along the borders, tell what is covered; no join is needed.
    """
    marks = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step")))).alias("m")).select(*keys, "m.*")
    borders = marks.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    covered = borders.withColumn("depth", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w))
    return covered.where("depth > 0").select(*keys, F.col("at").alias("start"), (F.col("next") - 1).alias("end"))
