"""Near duplicates by SimHash and anchor points.

Fingerprints of 64 bits are cut into blocks, three or, where there are very many of them, two; two that differ in at most four bits differ in at most
one (two) bits of some block. For each block, the words of a covering code (a Hamming code beside free bits, radius 1) are the anchors, and a
fingerprint goes to every anchor within 1 + 1 (1 + 2) bits, so that both of such a pair meet at the one's nearest anchor. There they are
compared whole. Equal fingerprints are merged beforehand, and each anchor passes on a spanning forest of its links, not all pairs. Anchors with very many
fingerprints are dealt out in tiles, any two of whose shares meet in one of these; rows of frequent keys are joined by a broadcast of these keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ROW, small_batches, stored, utf8

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (first bit, bits) of the blocks of the two layouts. By the pigeonhole principle some block differs in THRESHOLD // len(blocks) bits at most.
#: The first sends a fingerprint to 45 of 2^19 anchors, the second to 343 of 2^28; it pays once anchors of the first hold thousands.
BLOCKS, WIDE_BLOCKS = ((0, 22), (22, 21), (43, 21)), ((0, 32), (32, 32))
#: Distinct fingerprints from which the second layout is used.
MANY = 50_000_000
#: Fingerprints of an anchor that one task compares; of more, each pair of shares of this size is a task.
TILE = 1 << 15
#: A key is frequent if it has at least one in so many rows; so there are no more such keys.
FREQUENT = 256
#: Keys up to which a table of them is broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows at an anchor up to which all its pairs are compared at once.
SMALL = 64


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] if len(words) > SHINGLE else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, long columns `keys` and the fingerprint, as a signed long, of every row of `docs` (doc_id, text). A null text counts as empty: fingerprint 0."""
    keys = ("doc_id", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(len(keys)))
            f = np.fromiter((fingerprint(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(f.view(np.int64))], names=[*keys, "fp"])

    small_batches(docs.sparkSession)
    return docs.select(*(F.col(k).cast("long").alias(k) for k in keys), "text").mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "fp")))


def _code(bits: int) -> tuple[int, np.ndarray]:
    """Length of the Hamming code in a block, and what flipping each bit adds to the syndrome: the code's columns, then nothing for free bits."""
    length = (1 << (bits + 1).bit_length() - 1) - 1
    return length, np.array([*range(1, length + 1), *[0] * (bits - length)], np.int64)


def anchors(x: np.ndarray, bits: int, reach: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all code words within `reach` bits of each block value."""
    length, columns = _code(bits)
    s = np.zeros(len(x), np.int64)
    for k in range(length):
        s ^= np.where(x >> k & 1, k + 1, 0)
    order = np.argsort(s, kind="stable")  # rows by syndrome
    at = np.searchsorted(s[order], np.arange(length + 2))
    rows, words = [], []
    for flips in (f for n in range(reach + 1) for f in combinations(range(bits), n)):
        effect = mask = 0
        for f in flips:
            effect ^= int(columns[f])
            mask |= 1 << f
        hit = order[at[effect] : at[effect + 1]]
        rows.append(hit)
        words.append(x[hit] ^ mask)
    return np.concatenate(rows), np.concatenate(words)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Each linked value with the smallest of its component."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in up]
    return [x for x, r in pairs if x != r], [r for x, r in pairs if x != r]


def _linked(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the groups of `fps`. Small groups are compared at all distances at once; in a large one each fingerprint is
    compared with those that nothing has reached yet, which finds the same components."""
    small = np.repeat(sizes <= SMALL, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    f, g = fps[small], group[small]
    for d in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=0)))):
        near = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= THRESHOLD))
        if len(near):
            yield f[near], f[near + d]
    for k in np.flatnonzero(sizes > SMALL):
        rest = np.unique(fps[starts[k] : starts[k] + sizes[k]])
        while len(rest) > 1:
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                near = np.bitwise_count(rest ^ x) <= THRESHOLD
                if near.any():
                    found, rest = rest[near], rest[~near]
                    yield np.full(len(found), x), found
                    todo += list(found)


def links(fps: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b), b < a: a spanning forest at each anchor of the links between distinct fingerprints of column fp. n: how many there are, which decides the layout."""
    blocks = WIDE_BLOCKS if (fps.count() if n is None else n) >= MANY else BLOCKS
    reach = 1 + THRESHOLD // len(blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(f), 1 << 13):
                part = f[i : i + (1 << 13)]
                for k, (first, bits) in enumerate(blocks):
                    row, word = anchors((part >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64), bits, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(word | k << 32), pa.array(part[row].view(np.int64))], names=["anchor", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; those of the last anchor of a batch wait for the next."""
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(a, f):
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            found = list(_linked(f, starts, np.diff(starts, append=len(a)))) if len(a) else []
            if found:
                far, near = _forest(*(np.concatenate(x).view(np.int64) for x in zip(*found)))
                return pa.RecordBatch.from_arrays([pa.array(far, pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])

        for b in batches:
            a = np.concatenate([held_a, b.column(0).to_numpy().astype(np.int64)])
            f = np.concatenate([held_f, b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
            held_a, held_f = a[cut:], f[cut:]
            if (out := done(a[:cut], f[:cut])) is not None:
                yield out
        if (out := done(held_a, held_f)) is not None:
            yield out

    spread_out = fps.select("fp").mapInArrow(spread, "anchor long, fp long")
    crowded = stored(spread_out.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "crowded")
    if not crowded.isEmpty():  # of n fingerprints, share i meets share j in the tile (i, j)
        shares = F.ceil(F.col("n") / TILE)
        own = spread_out.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, "anchor", "left").withColumn("share", F.pmod(F.xxhash64("fp"), shares))
        tiles = F.transform(F.sequence(F.lit(0).cast("long"), shares - 1), lambda j: -F.abs(F.xxhash64("anchor", F.least("share", j), F.greatest("share", j)) % (1 << 62)) - 1)
        spread_out = own.select(F.explode(F.when(F.col("n").isNull(), F.array("anchor")).otherwise(tiles)).alias("anchor"), "fp")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(meet, "a long, b long").distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `table` (each key once, column n: its rows among the `total`), inner join; the rows of frequent keys stay where they are."""
    frequent = table.where(F.col("n") * FREQUENT >= total).drop("n")  # FREQUENT keys at most
    often = rows.join(F.broadcast(frequent), key)
    seldom = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(table.where(F.col("n") * FREQUENT < total).drop("n"), key)
    return often.unionByName(seldom)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root the smallest of its component.

    Alternates large-star and small-star steps, each a written table, until nothing changes; the rounds grow with the logarithm of
    the nodes, and a step passes on at most as many rows as there are edges.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        large = stored(looked_up(both, least, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, least, "a", n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last, n = now, now[0]


def _rooted(distinct: DataFrame) -> DataFrame:
    """`distinct`, whose column fp has each fingerprint once, with column root: the smallest fingerprint of its class."""
    distinct = stored(distinct, "distinct")
    roots = components(links(distinct, distinct.count()))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row of `docs`.

    Null and empty texts share fingerprint 0 and are linked like any other; a null doc_id counts as larger than all others. Rows
    with equal doc_id are rows of their own.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    rooted = stored(_rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    merged = stored(looked_up(rooted.withColumnRenamed("n", "rows"), named, "root", rooted.count()).select("fp", "component_id", F.col("rows").alias("n")), "merged")
    return looked_up(marked, merged, "fp", marked.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of `docs`, as `classes` has them; a null text has the fingerprint of an empty one."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates, all columns: that with the smallest doc_id (null ones last), of equal ones the least
    by text, of equal ones any. Rows with equal or null doc_id are rows of their own."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    marked = stored(fingerprints(rows, ROW), "fingerprints")
    # of each fingerprint, the smallest doc_id with its number of rows and one of them; then of each class
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"), "n")
    by_id = marked.groupBy("fp", "doc_id").agg(F.min(ROW).alias(ROW), F.count("*").alias("n"))
    rooted = stored(_rooted(by_id.groupBy("fp").agg(F.min(first).alias("first"))), "roots")
    least = rooted.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id")).alias("least"), F.count("*").alias("n"))
    leading = looked_up(rooted, least, "root", rooted.count()).where("first.none = least.none and first.doc_id <=> least.doc_id").select("root", "fp", "first.*")
    named = stored(leading.groupBy("root").agg(F.sum("n").alias("n"), F.min("row").alias(ROW)), "leading")
    kept = named.where("n = 1").select(ROW)
    ties = leading.join(named.where("n > 1").select("root"), "root").select("root", "fp", F.col("doc_id").alias("tied"))
    if not ties.isEmpty():
        tied = stored(marked.join(ties, "fp").where("doc_id <=> tied").select(ROW, "root"), "tied")
        texts = rows.select(ROW, "text").join(F.broadcast(tied) if tied.count() <= BROADCAST_ROWS else tied, ROW)
        kept = kept.unionByName(texts.groupBy("root").agg(F.min(F.struct(F.col("text").isNull(), "text", ROW)).alias("best")).select(F.col("best")[ROW].alias(ROW)))
    dropped = stored(marked.join(kept, ROW, "left_anti").select(ROW), "dropped")
    return rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, ROW, "left_anti").select(*docs.columns)
