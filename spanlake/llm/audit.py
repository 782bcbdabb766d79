"""How filters overlap: what each removes, and when it comes too late, in every order of applying them.

A text's failures are a mask. Masks are counted by part, and each counted cell is folded over the array of all orders (a constant that goes with the plan) by
higher-order functions: a struct for each order and step, weighted by the cell's counts. A part's cells, 2^filters at most, are merged by elementwise sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import batch, chunks, small_batches, stored, sums, utf8, word_hashes

#: Letters of the filters; a text fails the last one if it is identical to that of a smaller doc_id.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    starts, lengths = offsets[:-1], np.diff(offsets)
    hashes, at = word_hashes(data, offsets)
    words = np.diff(at)
    distinct = np.fromiter((len(np.unique(hashes[i:j])) for i, j in zip(at, at[1:])), np.int64, len(words))
    capitals = sums((data >= 65) & (data <= 90), starts, lengths)
    points = sums((data & 0xC0) != 0x80, starts, lengths)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    fails = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points, sums(symbols[data], starts, lengths) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def judged(docs: DataFrame, part: Column, fails: Callable = failures) -> DataFrame:
    """doc_id, part, mask and the digest of the text of every row of `docs`; a null text counts as empty, a null part as an empty string."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(2))
            data, at = data[at[0] : at[-1]], at - at[0]
            digests = [hashlib.sha256(data[i:j]).digest()[:16] for i, j in zip(at, at[1:])]
            masks = [fails(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
            yield batch(schema, b.column(0), b.column(1), np.concatenate([np.zeros(0, np.int32), *masks]), digests)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (with the bit of identical texts) and the numbers n, good and toxic of their rows.

    Rows are counted before they meet: a group of copies is a row for each part and label. Labels of a doc_id that has several rows hold if one of them does.
    A null doc_id has no label, and counts as larger than all others; rows that share the smallest doc_id of a text all pass.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = stored(marks.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")).where("good + toxic > 0"), "marks")
    group = ["digest", "part", "mask", "good", "toxic"]
    once = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]).groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    copies = once.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n").alias("first"))).alias("least"))
    least = F.struct("least.none", "least.doc_id")
    leads = least.eqNullSafe(F.min(least).over(Window.partitionBy("digest")))
    copies = copies.withColumn("first", F.when(leads, F.col("least.first")).otherwise(F.lit(0)))
    passing, failing = F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(LETTERS) - 1).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
    told = copies.select("part", "good", "toxic", F.explode(F.array(passing, failing)).alias("cell")).where("cell.n > 0")
    return told.groupBy("part", "cell.mask").agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))


def folded(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of each, for all orders of the filters; a part has a row for each order and step."""
    orders = [*permutations(range(len(letters)))]
    every = F.array(*(F.array(*map(F.lit, o)) for o in orders))
    empty = F.array().cast(f"array<struct<filter: int, {', '.join(f'{c}: bigint' for c in COUNTS)}>>")

    def step(state: Column, f: Column) -> Column:
        fails, gone = F.getbit("mask", f) == 1, state["gone"]
        count = lambda condition, of="n": F.when(condition, F.col(of)).otherwise(F.lit(0)).cast("long")
        alone = F.col("mask") == F.pow(F.lit(2), f)
        values = (count(~gone & ~fails), count(~gone & fails), count(gone & fails), count(alone), count(~gone & fails, "good"), count(~gone & fails, "toxic"))
        one = F.struct(f.alias("filter"), *(v.alias(c) for c, v in zip(COUNTS, values)))
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(one)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), empty.alias("steps"))
    one_cell = F.flatten(F.transform(every, lambda o: F.aggregate(o, start, step, lambda s: s["steps"])))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x["filter"].alias("filter"), *((x[c] + y[c]).alias(c) for c in COUNTS)))
    by_part = cells.select("part", one_cell.alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("all"))
    merged = by_part.select("part", F.aggregate(F.slice("all", 2, 1 << len(letters)), F.col("all")[0], added).alias("steps"))
    named = F.array(*(F.lit("".join(letters[f] for f in o)) for o in orders))
    rows = merged.select("part", F.posexplode("steps").alias("place", "at"))
    order, step = named[F.floor(F.col("place") / len(letters)).cast("int")].alias("filter_order"), (F.col("place") % len(letters) + 1).cast("int").alias("step")
    return rows.select("part", order, step, *(f"at.{c}" for c in COUNTS), F.sum("at.removed").over(Window.partitionBy("part", "at.filter")).alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each part of `docs` (values of that column), each order of the five filters and each step: how many rows are kept after it, removed by it, fail it
    though removed before (redundant) or fail nothing else (unique_fails), the good and toxic ones among the removed, and what the filter removes over all orders (shapley).

    Null texts are empty and fail A, null parts are the empty string, further columns are ignored, an empty table has no rows.
    """
    return folded(cells(judged(docs, F.col(part)), labels))
