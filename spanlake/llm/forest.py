"""Near duplicates by MinHash and an LSH forest, confirmed on whole shingle sets.

Equal sets are merged first. Each tree of the forest sorts the sets by its own order of MinHash values; rows that follow one another and share a prefix are
neighbours with the longest common prefix, whose depth so follows how crowded the region is. Neighbours in all trees are confirmed on their whole sets, and grow
components. What is left are regions (a tree's prefix of three values) whose rows belong to several components: their rows that look similar to one of another
component by one bit of each value are compared on whole sets, region by region, and give a spanning forest of links, not pairs. Crowded regions are descended first: each is
divided by two further values, ten times over with values of other trees, so that a pair that links still meets in one division with near certainty; what is
crowded even then is dealt out in tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import batch, mixed, small_batches, stored, utf8, word_hashes
from spanlake.llm.simhash import BROADCAST_ROWS, components, looked_up

SHINGLE, PERCENT = 2, 80
#: Trees, values in the prefix of a region and in what a tree is sorted by beyond it. A pair at the least similarity shares a region with probability 1 - (1 - 0.8^3)^12 = 0.9998.
TREES, PREFIX, TAIL = 12, 3, 4
#: MinHash values; one bit of each is kept. Of a pair at the least similarity 460.8 bits agree on average, with a deviation of 6.8; fewer than LIKE don't come up once in 100,000 pairs.
VALUES, LIKE = 512, 430
#: Following rows that each row of an order is a candidate with.
NEIGHBOURS = 2
#: Rows and shingles of a region that are compared at once; divisions of more crowded ones.
REGION, VOLUME, DIVISIONS = 2048, 1 << 22, 10
#: Rows of a region up to which all its pairs are compared by shifts.
SMALL = 64

_FACTORS = (np.random.default_rng(13).integers(0, 1 << 31, VALUES, dtype=np.uint32) * 2 + 1).reshape(-1, 1)
_SALT = np.arange(VALUES, dtype=np.uint64) << np.uint64(32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; fewer words are one shingle, no word is none. data: lower-cased bytes."""
    hashes, at = word_hashes(data, offsets)
    out = []
    for i, j in zip(at.tolist(), at[1:].tolist()):
        size = min(n, j - i)
        if not size:
            out.append(hashes[:0])
            continue
        h = np.full(j - i - size + 1, size, np.uint64)
        for k in range(size):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i + k : j - size + k + 1])
        out.append(np.unique(h))
    return out


def minima(one: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    x, least = (one >> np.uint64(32)).astype(np.uint32), np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024] * _FACTORS).min(axis=1), out=least)
    return mixed(least.astype(np.uint64) | _SALT)


def marked(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the digest of the set (null if it is empty), the values that trees are made of and a bit of each value, for every row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("deep", pa.binary()), ("bits", pa.binary())])
    used = TREES * (PREFIX + TAIL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            kept: dict[bytes, tuple] = {}
            sizes, digests, deep, bits = [], [], [], []
            for one in shingle_sets(_lowered(data), at, n):
                key = hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None
                if key and key not in kept:
                    v = minima(one)
                    kept[key] = (v[:used].astype(np.uint16).tobytes(), np.packbits((v >> np.uint64(63)).astype(bool)).tobytes())
                sizes.append(len(one))
                digests.append(key)
                deep.append(kept[key][0] if key else None)
                bits.append(kept[key][1] if key else None)
            yield batch(schema, b.column(0), sizes, digests, deep, bits)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, deep binary, bits binary")


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of values of one length as rows of a matrix."""
    data, at = utf8(column)
    return data[at[0] : at[-1]].view(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


_ORDER = "key long, tail long, node long, size long, bits binary"


def trees(nodes: DataFrame) -> DataFrame:
    """A row for each node (node, n_shingles, deep, bits) and tree: key (the tree and its prefix), tail (the values it is sorted by beyond), node, size, bits."""
    schema = pa.schema([("key", pa.int64()), ("tail", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deep = _fixed(b.column(2), np.uint16).astype(np.int64)
            for t in range(TREES):
                head, tail = deep[:, t * PREFIX : (t + 1) * PREFIX], deep[:, TREES * PREFIX + t * TAIL : TREES * PREFIX + (t + 1) * TAIL]
                key = (head << np.array([32, 16, 0])).sum(1) | t << 48
                last = (tail << np.array([47, 31, 15, 0])[:TAIL]).sum(1)
                yield batch(schema, key, last, b.column(0), b.column(1), b.column(3))

    return nodes.select("node", "n_shingles", "deep", "bits").mapInArrow(run, _ORDER)


def _agreement(bits: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How many bits of rows i and j agree; 0 where their sizes alone tell that they aren't linked."""
    a, b = size[i], size[j]
    agree = 8 * bits.shape[1] * bits.itemsize - np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
    return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), agree, 0)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def neighbours(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: nodes that follow one another in the order of a tree, share its prefix and look similar. Ranges of the order are tasks; pairs across their borders are left to regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), _fixed(b.column(4), np.uint64)]
            key, node, size, bits = now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            for d in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero(key[d:] == key[:-d])
                i = i[_agreement(bits, size, i, i + d, percent) >= LIKE]
                if len(i):
                    yield _pairs(node[i], node[i + d])
            held = [x[-NEIGHBOURS:] for x in now]

    return rows.repartitionByRange("key", "tail").sortWithinPartitions("key", "tail", "node").mapInArrow(run, "a long, b long").distinct()


def _numbered(rows: DataFrame, share: Column, shares: Column) -> DataFrame:
    """Rows of a crowded key dealt out in tiles: share i meets share j in the tile of both."""
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), shares - 1), lambda j: -F.abs(F.xxhash64("key", F.least(share, j), F.greatest(share, j)) % (1 << 62)) - 1)
    return rows.withColumn("key", F.explode(tiles))


def mixed_regions(members: DataFrame, deep: DataFrame) -> DataFrame:
    """key, node, size, root of the rows (key, node, size, root) in regions of several roots, at a depth that leaves at most REGION rows and VOLUME shingles in each, or tiles of these."""
    done, depth = None, 0
    while True:
        members = stored(members, "members")
        share = F.greatest(F.col("n") / REGION, F.col("volume") / VOLUME)
        sized = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last")
        sized = stored(sized.select("key", share.alias("share")), "regions")
        own = stored(members.join(F.broadcast(sized) if sized.count() <= BROADCAST_ROWS else sized, "key"), "own")
        small = own.where(F.col("share") <= 1).drop("share")
        done = small if done is None else done.unionByName(small)
        crowded = own.where(F.col("share") > 1)
        if crowded.isEmpty():
            return done
        if depth == 1:
            shares = F.ceil(2 * F.col("share"))
            return done.unionByName(_numbered(crowded, F.pmod(F.xxhash64("node"), shares), shares).drop("share"))
        # values of other trees: their tails, of which a tree's own order uses none
        word = lambda k: F.substring("deep", F.lit(1) + 2 * k, F.lit(2))
        tree = F.shiftright("key", 48)
        spots = (F.lit(TREES * PREFIX) + F.pmod(tree + 1 + d, F.lit(TREES)) * TAIL for d in range(DIVISIONS))
        keys = F.array(*(-F.abs(F.xxhash64("key", F.lit(d), word(k.cast("int")), word(k.cast("int") + 1)) % (1 << 62)) - 1 for d, k in enumerate(spots)))
        members, depth = crowded.join(deep.select("node", "deep"), "node").select(F.explode(keys).alias("key"), "node", "size", "root"), depth + 1


def _by_key(batches: Iterator[pa.RecordBatch], columns) -> Iterator[list]:
    """What `columns(batch)` gives (arrays, the key first), cut so that no key is divided; rows come sorted by key."""
    held = None
    for b in batches:
        now = columns(b)
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def similar_rows(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, node, root of the rows (key, node, size, bits, root) that look similar to a row of the same key and another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda b: [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _fixed(b.column(3), np.uint64), b.column(4).to_numpy()]
        for key, node, size, bits, root in _by_key(batches, columns):
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            sizes = np.diff(starts, append=len(key))
            few, hit = np.repeat(sizes, sizes) <= SMALL, np.zeros(len(key), bool)
            for d in range(1, min(SMALL, int(sizes.max()))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (root[d:] != root[:-d]) & few[d:])
                i = i[_agreement(bits, size, i, i + d, percent) >= LIKE]
                hit[i] = hit[i + d] = True
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                for i in range(s, s + n):
                    j = i + 1 + np.flatnonzero(root[i + 1 : s + n] != root[i])
                    j = j[_agreement(bits, size, np.full(len(j), i), j, percent) >= LIKE]
                    hit[j] = True
                    hit[i] |= len(j) > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, node, root)], names=["key", "node", "root"])

    return rows.select("key", "node", "size", "bits", "root").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, root long")


def _compared(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between different roots: whole sets as bits over the shingles that two of them have at least, by intersections of rows."""
    sizes = np.array([len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    width = int(np.count_nonzero(times > 1)) + 63 >> 6 << 6
    rows, ends = [], np.concatenate([[0], np.cumsum(sizes)])
    if not width:
        return
    for a, b in zip(ends, ends[1:]):
        flags = np.zeros(width, bool)
        own = number[place[a:b]]
        flags[own[own >= 0]] = True
        rows.append(np.packbits(flags))
    bits, label = np.array(rows).view(np.uint64), roots.copy()
    for i in range(len(nodes) - 1):
        j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :])))
        if not len(j):
            continue
        shared = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        j = j[100 * shared >= percent * (sizes[i] + sizes[j] - shared)]
        for k in j[np.unique(label[j], return_index=True)[1]].tolist():
            yield int(nodes[i]), int(nodes[k])
            label[label == label[k]] = label[i]


def region_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): a spanning forest of the links between nodes of the same key and different roots (rows: key, node, root, hashes), on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(b):
            sets = np.empty(b.num_rows, object)
            at, values = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy()
            for k in range(b.num_rows):
                sets[k] = values[at[k] : at[k + 1]]
            return [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), sets]

        for key, node, root, sets in _by_key(batches, columns):
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            found = [x for s, e in zip(starts, [*starts[1:], len(key)]) for x in _compared(node[s:e], root[s:e], sets[s:e].tolist(), percent)]
            if found:
                a, b = np.array(found, np.int64).T
                yield _pairs(a, b)

    return rows.select("key", "node", "root", "hashes").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def whole_sets(docs: DataFrame, nodes: DataFrame, n: int = SHINGLE) -> DataFrame:
    """node and the array of its shingles' hashes, for `nodes` (node, doc_id, digest): read again from a row of `docs` with that doc_id whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(2))
            sets = shingle_sets(_lowered(data), at, n)
            digests = b.column(1).to_pylist()
            same = [k for k, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digests[k]]
            ends = np.cumsum([0, *(len(sets[k]) for k in same)])
            whole = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in same)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(same, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole))], names=["node", "hashes"])

    small_batches(docs.sparkSession)
    wanted = nodes.select("node", F.col("doc_id").alias("id"), "digest")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, own["doc_id"].eqNullSafe(F.col("id")))
    return found.select("node", "digest", "text").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, hashes) are similar enough."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"of_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.size("of_a") + F.size("of_b")).alias("sum"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return both.where(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of `docs`.

    Rows with equal sets are linked, rows without a word (null and empty texts) with nothing: their component_id is their doc_id. A null doc_id counts as
    larger than all others; rows with equal doc_id are rows of their own.
    """
    rows = stored(marked(docs, n), "marked")
    filled = rows.where(F.col("digest").isNotNull())
    merged = filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("deep").alias("deep"), F.first("bits").alias("bits"))
    nodes = stored(stored(merged, "merged").withColumn("node", F.monotonically_increasing_id()), "nodes")

    near = stored(neighbours(trees(nodes), percent), "near")
    links = stored(confirmed(near, sets_of(docs, nodes, near.select(F.explode(F.array("a", "b")).alias("node")), n), percent), "links")
    roots = stored(components(links), "roots")
    members = _rooted(trees(nodes).select("key", "node", "size"), roots)
    open_rows = stored(mixed_regions(members, nodes), "open")
    similar = stored(similar_rows(open_rows.join(nodes.select("node", "bits"), "node"), percent), "similar")
    if not similar.isEmpty():
        late = region_links(similar.join(sets_of(docs, nodes, similar.select("node"), n), "node"), percent)
        roots = stored(components(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")

    rooted = stored(_rooted(nodes.select("node", "digest", "doc_id", "rows"), roots), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = stored(looked_up(rooted.drop("doc_id"), least, "root", rooted.count()).select("digest", "component_id", F.col("rows").alias("n")), "named")
    linked = looked_up(filled, named, "digest", filled.count()).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The whole sets of the wanted nodes (node, repeats allowed), written."""
    return stored(whole_sets(docs, stored(nodes.select("node", "doc_id", "digest").join(wanted.distinct(), "node"), "wanted"), n), "sets")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`classes` with kept: whether doc_id is that of the component (null-safe)."""
    return classes(docs, n, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
