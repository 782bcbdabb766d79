"""Language-model scores by logistic context mixing.

A text is its lower-cased words and an end. A word that is frequent in the training texts is coded as the bits of its path in a Huffman tree, any other one by
an escape, then by its share of such words or, if no training text has it, letter by letter along a tree of bytes. Hashed contexts predict each bit from counts
over all training texts: for words none, the last very frequent word and the word before; for letters one to five bytes. The predictions are mixed in
the logistic domain by weights gated by how often the contexts were seen with the node, and the mix is refined while a text is read: block by block, each text's own correction
of the weights follows the gradient of its coding cost. A block is coded with what came before it alone, so the sum is the log-probability of the text.

Counts of words grow with the corpus and are joined, not held; the tree has at most 1 / HOT words; tables of hashed contexts have a fixed size, as their bits share cells.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import chunks, fold, lowered, small_batches, stored, stretches, utf8

#: Words that make up at least this share of the training words have a place in the tree and are known to every task, so there are at most 1 / HOT of them.
HOT = 2.0**-20
#: The most frequent words, of which the last one is a context.
MARKERS = 255
#: Bits of the tables of word contexts (last marker, word before), and of letter contexts (one to five bytes).
WORD_TABLES, LETTER_TABLES = (19, 20), (16, 18, 20, 20, 20)
#: Counts of a cell from which a context counts as seen a little, well, and very well.
SEEN = (2, 16, 128)
#: What a context weighs, by these degrees, beside 1 for the shortest one; all weights of a gate sum to SHARPNESS.
PULL, SHARPNESS = ((0.0, 0.5, 1.5, 3.0), (0.0, 0.3, 1.0, 2.0)), 1.05
#: The first block of a text, in words; each later one doubles, up to the last figure.
FIRST_BLOCK, LAST_BLOCK = 16, 1024
RATE = 0.02
#: Bytes of text that are cut into words at once, and symbols that are coded at once (of several texts; a longer text goes block by block all the same).
CHUNK, GROUP = 1 << 21, 1 << 16

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_A, _NODE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_LOG10 = math.log(10)
_LOGITS = ((np.arange(256) - 128) / 16).astype(np.float32)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words in the stretches data[at[i]:at[i + 1]], dictionary-encoded, and how many each stretch has."""
    d = lowered(data[at[0] : at[-1]])
    at = at - at[0]
    solid = ~_SPACE[d]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edge = at[:-1][at[:-1] < len(d)]
    start[edge] = solid[edge]
    first = np.flatnonzero(start)
    place = np.cumsum(solid)
    offsets = np.append(place[first] - 1, place[-1] if len(place) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(d[solid])])
    return words.dictionary_encode(), np.diff(np.searchsorted(first, at))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    out = np.repeat(start - ends + size, size)
    out += np.arange(len(out), dtype=out.dtype)
    return out


@dataclass
class Tree:
    """A Huffman tree's paths, one after the other: symbol s takes length[s] steps from first[s] on, each a node and a sign (1 for the second child). plain: each
    node's logit from the symbols' own counts."""

    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray
    plain: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """Of symbols with these counts; a count of 0 passes for a half."""
    heap = [(max(float(c), 0.5), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    n, children, plain = len(heap), [], []
    while len(heap) > 1:
        (c, a), (d, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (c + d, n + len(children)))
        children.append((a, b))
        plain.append(math.log(d / c))
    parent = np.full(n + len(children), -1, np.int64)
    side = np.zeros(n + len(children), np.int8)
    for k, (a, b) in enumerate(children):
        parent[a] = parent[b] = k
        side[a], side[b] = -1, 1
    length, at, steps = np.zeros(n, np.int32), np.arange(n), []
    while True:  # all symbols climb together, from the leaf to the root
        up = parent[at]
        if not (up >= 0).any():
            break
        length += up >= 0
        steps.append((np.where(up >= 0, up, -1).astype(np.int32), side[at]))
        at = np.where(up >= 0, n + up, at)
    first = np.cumsum(length) - length
    nodes, signs = np.zeros(int(length.sum()), np.int32), np.zeros(int(length.sum()), np.int8)
    for k, (node, sign) in enumerate(steps):
        on = np.flatnonzero(node >= 0)
        nodes[first[on] + k], signs[first[on] + k] = node[on], sign[on]
    return Tree(first.astype(np.int32), length, nodes, signs, np.array(plain or [0.0], np.float32))


def cells(hashed: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a table for a context's hash and a node."""
    return ((hashed ^ (node.astype(np.uint32) * _NODE)) * _A) >> np.uint32(32 - bits)


def table(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Cells as uint16: the logit in sixteenths, offset by 128, below how well the cell was seen."""
    logit = np.clip(np.log((ones + 0.4) / (zeros + 0.4)) * 16, -127, 127).astype(np.int16) + 128
    return (logit + (np.searchsorted(SEEN, ones + zeros, side="right") << 8)).astype(np.uint16)


def _weights(contexts: int) -> np.ndarray:
    """Of the plain predictor and the contexts, by gate: how well each of the two longest contexts was seen."""
    a, b = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    pulls = np.stack([np.ones(16), *([np.take(PULL[0], a)] * (contexts - 2)), np.take(PULL[0], a), np.take(PULL[1], b)])
    return (SHARPNESS * pulls / pulls.sum(0)).astype(np.float32)


def _blocks(sizes: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(texts, start, ends) of the block that each text still has, step by step."""
    start, width = 0, int(sizes.max(initial=0)) if whole else FIRST_BLOCK
    alive = np.flatnonzero(sizes > 0)
    while len(alive):
        yield alive, start, np.minimum(sizes[alive], start + width)
        start, width = start + width, min(2 * width, LAST_BLOCK)
        alive = alive[sizes[alive] > start]


def coded(tree: Tree, tables: list[np.ndarray], symbols: np.ndarray, contexts: list[np.ndarray], sizes: np.ndarray, adapt: bool) -> np.ndarray:
    """Natural log-probability of each sequence (sizes: their lengths; symbols one after the other). contexts: a hash for each symbol, by table.

    adapt: refine the weights within a sequence.
    """
    starts = np.cumsum(sizes) - sizes
    weights = _weights(len(tables))
    bits = [int(len(t)).bit_length() - 1 for t in tables]
    own, out = np.zeros((len(weights), len(sizes)), np.float32), np.zeros(len(sizes))
    for alive, start, end in _blocks(sizes, not adapt):
        at = _ranges((starts[alive] + start).astype(np.int32), (end - start).astype(np.int32)) if start or len(alive) < len(sizes) or not (end == sizes).all() else slice(None)
        s = symbols[at]
        n = tree.length.take(s)
        path = _ranges(tree.first.take(s).astype(np.intp), n)
        node, sign = tree.nodes.take(path), tree.signs.take(path)
        per = np.add.reduceat(n, np.cumsum(end - start) - (end - start))  # bits of each sequence
        begin = np.cumsum(per) - per
        found = [t.take(cells(np.repeat(c[at], n), node, b)) for t, c, b in zip(tables, contexts, bits)]
        gate = (((found[-2] >> 8) << 2) + (found[-1] >> 8)).astype(np.intp)
        said = [tree.plain.take(node), *(_LOGITS.take(x.view(np.uint8)[::2]) for x in found)]
        mixed = np.zeros(len(node), np.float32)
        for j, x in enumerate(said):
            w = weights[j].take(gate)
            if start:
                w += np.repeat(own[j, alive], per)
            mixed += w * x
        miss = 1 / (1 + np.exp(np.clip(mixed * sign, -20, 20)))  # probability of the other bit
        out[alive] += np.add.reduceat(np.log1p(-np.minimum(miss, np.float32(1 - 1e-6))), begin, dtype=np.float64)
        if adapt:
            miss *= sign
            for j, x in enumerate(said):
                own[j, alive] += RATE * np.add.reduceat(miss * x, begin) / np.sqrt(per)
    return out


def word_contexts(symbols: np.ndarray, sizes: np.ndarray, start: int) -> list[np.ndarray]:
    """Hashes of the last marker before each symbol, and of the symbol before; `start` stands before a text."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[begin] = start
    place = np.where(before < MARKERS, np.arange(len(before), dtype=np.int32), 0)
    place[begin] = begin
    return [before[np.maximum.accumulate(place)].astype(np.uint32) * np.uint32(0xC2B2AE35), before.astype(np.uint32) * np.uint32(0x27D4EB2F) + np.uint32(1)]


def letter_contexts(b: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one, two, ... bytes before each byte of words, one for each table; 0 stands before a word."""
    since = _ranges(np.zeros(len(sizes), np.int32), sizes.astype(np.int32))
    out, held = [], np.zeros(len(b), np.uint32)
    for k in range(1, len(LETTER_TABLES) + 1):
        back = np.where(since >= k, np.concatenate([np.zeros(k, np.uint8), b[:-k]])[: len(b)], 0).astype(np.uint32)
        held = held * np.uint32(0x01000193) ^ back
        out.append(held * np.uint32(0x27D4EB2F) + np.uint32(k))
    return out


@dataclass
class Model:
    """known: the words in the tree, the most frequent first. logs: log10 of their counts and one. The end's, the escape's and the start's symbol follow the words."""

    known: pa.Array
    logs: np.ndarray
    words: Tree
    word_tables: list[np.ndarray]
    letters: Tree
    letter_tables: list[np.ndarray]

    def read(self, data: np.ndarray, offsets: np.ndarray, others: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Symbols of the texts one after the other, each with its end; how many each text has; (text, word, times) of the words that aren't in the tree, if these
        `others` are wanted."""
        n, edges = len(self.known), stretches(data, offsets, CHUNK)
        owner = np.minimum(np.searchsorted(offsets, edges[:-1], side="right"), len(offsets) - 1) - 1  # an empty text adds nothing to any
        found, sizes, rare = [np.zeros(0, np.int32)], np.zeros(len(offsets) - 1, np.int64), []
        for i, j in chunks(edges, CHUNK):
            words, each = tokens(data, edges[i : j + 1])
            ids = pc.index_in(words.dictionary, value_set=self.known).fill_null(n + 1).to_numpy()
            index = words.indices.to_numpy()
            symbols = ids[index]
            np.add.at(sizes, owner[i:j], each)
            new = np.flatnonzero(symbols > n) if others else ()
            if len(new):
                key, times = np.unique(np.repeat(owner[i:j], each)[new] * len(ids) + index[new], return_counts=True)
                rare.append((key // len(ids), words.dictionary.take(pa.array(key % len(ids))), times))
            found.append(symbols)
        texts, words, times = (np.concatenate([r[0] for r in rare]), pa.concat_arrays([r[1] for r in rare]), np.concatenate([r[2] for r in rare])) if rare else (np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64))
        return np.insert(np.concatenate(found), np.cumsum(sizes), n), sizes + 1, (texts, words, times)

    def score(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text's words in the tree, escapes and end."""
        at, out = np.concatenate([[0], np.cumsum(sizes)]), [np.zeros(0)]
        for i, j in chunks(at, GROUP):
            own = symbols[at[i] : at[j]]
            out.append(coded(self.words, self.word_tables, own, word_contexts(own, sizes[i:j], len(self.known) + 2), sizes[i:j], True))
        return np.concatenate(out) / _LOG10

    def spell(self, words: pa.Array) -> np.ndarray:
        """log10 of each word's probability letter by letter."""
        letters, sizes = spelling(words)
        at, out = np.concatenate([[0], np.cumsum(sizes)]), [np.zeros(0)]
        for i, j in chunks(at, GROUP):
            own = letters[at[i] : at[j]]
            out.append(coded(self.letters, self.letter_tables, own, letter_contexts(own, sizes[i:j]), sizes[i:j], False))
        return np.concatenate(out) / _LOG10


def spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, a space behind each, and their numbers."""
    data, at = utf8(words)
    return np.insert(data[at[0] : at[-1]], at[1:] - at[0], 32), np.diff(at) + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n_train) over all rows of `docs` (text, train), the end of a text not among them; 0 for words of other texts only. Counts are summed up by chunks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(0))
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = stretches(data, at, 2 * CHUNK)
            owner = np.minimum(np.searchsorted(at, edges[:-1], side="right"), len(at) - 1) - 1
            for i, j in chunks(edges, 2 * CHUNK):
                words, each = tokens(data, edges[i : j + 1])
                n = len(words.dictionary)
                times = np.bincount(words.indices.to_numpy()[np.repeat(train[owner[i:j]], each)], minlength=n)
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(times)], names=["word", "n_train"])

    small_batches(docs.sparkSession)
    return docs.select("text", "train").mapInArrow(run, "word binary, n_train long").groupBy("word").agg(F.sum("n_train").alias("n_train"))


def _summed(counts: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The tables of counts (cell, ones, zeros); there are no more rows than cells."""
    found = counts.groupBy("cell").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    ones, zeros = np.zeros((2, sum(1 << b for b in bits)), np.float32)
    cell = found.column("cell").to_numpy()
    ones[cell], zeros[cell] = found.column("ones").to_numpy(), found.column("zeros").to_numpy()
    edges = np.cumsum([0, *(1 << b for b in bits)])
    return [table(ones[a:b], zeros[a:b]) for a, b in zip(edges, edges[1:])]


def _count(tree: Tree, bits: tuple[int, ...], sequences) -> Iterator[pa.RecordBatch]:
    """(cell, ones, zeros) of all tables, in one numbering, from (symbols, contexts) of sequences."""
    counts = [np.zeros(2 << b, np.int32) for b in bits]
    for symbols, contexts in sequences:
        for i in range(0, len(symbols), 4 * GROUP):
            s = symbols[i : i + 4 * GROUP]
            n = tree.length.take(s)
            path = _ranges(tree.first.take(s), n)
            node, zero = tree.nodes.take(path), tree.signs.take(path) < 0
            for k, (c, b) in enumerate(zip(contexts, bits)):
                cell = cells(np.repeat(c[i : i + 4 * GROUP], n), node, b)
                counts[k] += np.bincount(np.where(zero, cell + np.uint32(1 << b), cell), minlength=2 << b).astype(np.int32)
    counts = np.concatenate([c.reshape(2, -1) for c in counts], axis=1)
    hit = np.flatnonzero(counts.any(0))
    for i in range(0, len(hit), 1 << 18):
        part = hit[i : i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["cell", "ones", "zeros"])


_CELLS = "cell int, ones int, zeros int"


def train(texts: DataFrame, words: DataFrame, hot: list[tuple[bytes, int]], ends: int, rare: int) -> Model:
    """From all rows of column text, all of `words` (word, n_train) and the words of the tree (hot: with their counts, the most frequent first).
    ends, rare: counts of the end and the escape."""
    context = texts.sparkSession.sparkContext
    letters = _letter_counts(words)
    tree = huffman(np.array([*(c for _, c in hot), ends, rare], float))
    model = Model(pa.array([w for w, _ in hot], pa.binary()), np.log10(np.array([*(c for _, c in hot), ends, 0], float) + 1), tree, [], huffman(letters), [])
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def sequences():
            for b in batches:
                data, at = utf8(b.column(0))
                for i, j in chunks(at, CHUNK):
                    symbols, sizes, _ = model.read(data, at[i : j + 1], False)
                    yield symbols, word_contexts(symbols, sizes, len(model.known) + 2)

        yield from _count(model.words, WORD_TABLES, sequences())

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (spelling(b.column(0)) for b in batches)
        yield from _count(shared.value.letters, LETTER_TABLES, ((x, letter_contexts(x, n)) for x, n in pairs))

    model.word_tables = _summed(texts.select("text").mapInArrow(run, _CELLS), WORD_TABLES)
    model.letter_tables = _summed(words.where("n_train > 0").select("word").mapInArrow(spelled, _CELLS), LETTER_TABLES)
    shared.destroy()
    return model


def _letter_counts(words: DataFrame) -> np.ndarray:
    """How often the distinct training words have each byte; the space stands for their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            n += np.bincount(spelling(b.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(n)], names=["byte", "n"])

    out = np.zeros(256)
    for r in words.where("n_train > 0").select("word").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of `docs` (doc_id, text; other columns are ignored).

    A null text counts as empty: one token, the end; its bits are told as of one byte. Learns from rows whose crc32 mod 7 isn't 2; without any, every count is 0.
    Rows with equal or null doc_id are scored one by one, equal texts alike. A long text is cut into words piece by piece and scored block by block. No rows give none.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold(F.col("doc_id"), 7) != 2).alias("train"))
    words = stored(count_words(own), "words")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = words.agg(zero(F.sum("n_train")).alias("train"), zero(F.count_if(F.col("n_train") > 0)).alias("distinct"), zero(F.count_if(F.col("n_train") == 1)).alias("once")).first()
    ends = own.where("train").count()
    n_train, distinct = n.train + ends, n.distinct + (ends > 0)
    frequent = F.col("n_train") >= max(math.ceil(n.train * HOT), 1)  # by training texts alone: no other text has a say
    hot = sorted(((bytes(r.word), r.n_train) for r in words.where(frequent).select("word", "n_train").toLocalIterator()), key=lambda x: (-x[1], x[0]))
    escapes = n.train - sum(c for _, c in hot) + n.once + 1  # words that aren't in the tree, and as many new ones as there are words met once
    model = train(own.where("train"), words, hot, ends, escapes)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = model.logs > 0
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in chunks(at, CHUNK):
                symbols, sizes, (texts, found, times) = model.read(data, at[i : j + 1])
                begin = np.cumsum(sizes) - sizes
                lists = pa.array(np.searchsorted(texts, np.arange(j - i + 1)).astype(np.int32))
                order = np.argsort(texts, kind="stable")
                if (order != np.arange(len(order))).any():
                    found, times = found.take(pa.array(order)), times[order]
                    lists = pa.array(np.searchsorted(texts[order], np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(at[i : j + 1])), pa.array(sizes),
                        pa.array(np.add.reduceat(known[symbols], begin, dtype=np.int64)), pa.array(np.add.reduceat(model.logs[symbols], begin)), pa.array(model.score(symbols, sizes)),
                        pa.ListArray.from_arrays(lists, found), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "train", "n_bytes", "n_tokens", "n_known", "logs", "score", "words", "times"],
                )

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.spell(b.column(0)))], names=["word", "spelled"])

    small_batches(spark)
    done = own.select("doc_id", "text", "train").mapInArrow(run, "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, logs double, score double, words array<binary>, times array<int>")
    done = stored(done.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = done.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counts = words.where((F.col("n_train") > 0) & ~frequent).select("word", F.col("n_train").alias("c"), F.lit(0.0).alias("spelled"))
    new = words.where("n_train = 0").select("word").mapInArrow(spelled, "word binary, spelled double").select("word", F.lit(0).cast("long").alias("c"), "spelled")
    counted = rare.join(counts.unionByName(new), "word")
    share = F.when(F.col("c") > 0, F.log10(F.col("c").cast("double"))).otherwise(math.log10(n.once + 1) + F.col("spelled")) - math.log10(escapes)
    added = counted.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log"), F.sum(F.col("times") * share).alias("rest"))
    base = F.col("logs") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_train + distinct + 1)
    score = F.col("score") + F.coalesce("rest", F.lit(0.0))
    out = done.join(added, "row", "left")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
