"""Language identification by prediction by partial matching.

For each language a byte context tree of up to three bytes is counted on a bounded sample of labelled rows and then
frozen. A byte seen in a context costs its share, an unseen one costs the escape probability (method C) and is coded in the
next shorter context, down to a uniform 1/256. The language with the shortest exact code length wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import chunks, excerpt, fold, kept_rows, small_batches, sums, thinned, utf8

#: Bounds of the labelled sample that the trees are counted on.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 400, 32_768
#: Contexts of three bytes kept, by count; rarer ones are coded in their two-byte context.
MAX_CONTEXTS = 40_000
#: A text whose best code is longer than this many bits a byte is in none of the learned languages.
REJECT_BITS = 7.0

SCHEMA = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


@dataclass
class Trees:
    """symbols: of each byte; rows: the context row of each three symbols; cost: bits by row, symbol and language."""

    langs: list[str]
    symbols: np.ndarray
    n_symbols: int
    rows: np.ndarray
    cost: np.ndarray


def _symbols(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """A symbol and its three predecessors in the same text (0 before the start) for each byte."""
    s = symbols[data]
    since = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    back = [np.where(since >= k, np.concatenate([np.zeros(k, s.dtype), s[:-k]])[: len(s)], 0) for k in (1, 2, 3)]
    return s, *back


def _coded(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probability of each symbol (last axis): its share of the context, or the escape times the shorter context's."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    seen = counts / np.maximum(total + kinds, 1)
    return np.where(total == 0, shorter, np.where(counts > 0, seen, kinds / np.maximum(total + kinds, 1) * shorter))


def fit(rows: list[tuple[str, str]], max_contexts: int = MAX_CONTEXTS) -> Trees:
    """Count the trees on (language, text) pairs."""
    langs = sorted({lang for lang, _ in rows})
    lower = np.arange(256)
    lower[65:91] += 32
    texts = {lang: [t.encode() for x, t in rows if x == lang] for lang in langs}
    used = np.bincount(lower[np.frombuffer(b"".join(b"".join(t) for t in texts.values()), np.uint8)], minlength=256) > 0
    symbols = np.zeros(256, np.int32)
    symbols[used] = np.arange(1, used.sum() + 1)
    symbols, n = symbols[lower], int(used.sum()) + 1
    grams = []
    for lang in langs:
        data = np.frombuffer(b"".join(texts[lang]), np.uint8)
        offsets = np.cumsum([0, *map(len, texts[lang])])
        s, a, b, c = (x.astype(np.int64) for x in _symbols(data, offsets, symbols))
        grams.append((((c * n + b) * n + a) * n + s))
    ctx, freq = np.unique(np.concatenate([g // n for g in grams]) if grams else np.zeros(0, np.int64), return_counts=True)
    ctx = np.sort(ctx[np.argsort(-freq, kind="stable")[:max_contexts]])
    table = np.tile(np.arange(n * n, dtype=np.int32), n)
    table[ctx] = n * n + np.arange(len(ctx), dtype=np.int32)
    cost = np.empty(((n * n + len(ctx)) * n, max(1, len(langs))), np.float32)
    for k, g in enumerate(grams):
        order0 = _coded(np.bincount(g % n, minlength=n).astype(float), np.full(n, 1 / 256))
        order1 = _coded(np.bincount(g % n**2, minlength=n**2).reshape(n, n).astype(float), order0)
        order2 = _coded(np.bincount(g % n**3, minlength=n**3).reshape(n * n, n).astype(float), np.tile(order1, (n, 1)))
        at = np.searchsorted(ctx, g // n)
        hit = at < len(ctx)
        hit[hit] = ctx[at[hit]] == (g // n)[hit]
        order3 = _coded(np.bincount(at[hit] * n + (g % n)[hit], minlength=len(ctx) * n).reshape(-1, n).astype(float), order2[ctx % n**2])
        cost[:, k] = -np.log2(np.concatenate([order2.ravel(), order3.ravel()]))
    return Trees(langs, symbols, n, table, cost)


def code_lengths(trees: Trees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every text under every language's tree."""
    out = np.zeros((len(offsets) - 1, len(trees.langs)))
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        if not at[-1]:
            continue
        s, a, b, c = _symbols(data[offsets[i] : offsets[j]], at, trees.symbols)
        row = trees.rows[(c * trees.n_symbols + b) * trees.n_symbols + a]
        out[i:j] = sums(np.take(trees.cost, row * trees.n_symbols + s, axis=0), at[:-1], np.diff(at))
    return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """At most `rows` texts a language, chosen by a hash of the key; of a text over `text_bytes` pieces from all of it.

    Counts by language tell the share of keys that eight times the sample needs, so only about so many rows are ordered.
    """
    own = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return own.select("lang", "text").limit(0)
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, 8.0 * rows / n)))[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", F.xxhash64("text"))
    some = own.where(thinned(F.col("key"), share)).withColumn("text", excerpt(F.col("text"), text_bytes))
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("lang", "text")


def predict(docs: DataFrame, trees: Trees, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score and bits_per_byte of every row of `docs` beside nothing else.

    Null texts and texts without a letter get `und`, score 0 and null bits; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*trees.langs, "und"], object)
        for b in batches:
            data, offsets = utf8(b.column(1))
            bits = code_lengths(trees, data, offsets) if trees.langs else np.zeros((len(offsets) - 1, 1))
            best = bits.argmin(1)
            least = bits.min(1, keepdims=True)
            score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
            und = ~np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool) | (not trees.langs)
            best[und], score[und] = -1, 0
            size = np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(least[:, 0] / size, mask=und)], schema=SCHEMA)

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = docs.select(F.col(key).cast("long").alias("key"), F.when(letters, F.col(text)).alias("text"), letters.alias("letters"))
    small_batches(docs.sparkSession)
    return own.mapInArrow(run, "key long, lang_pred string, score double, bits_per_byte double")


def train(docs: DataFrame, **bounds) -> Trees:
    """Trees from the rows outside the held-out fold (crc32 mod 4 = 2)."""
    return fit([(r.lang, r.text) for r in sample(docs.where(fold(F.col("doc_id"), 4) != 2), **bounds).collect()])


def identify(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The whole operator on a table with doc_id, text and lang; other columns are ignored."""
    out = predict(docs, trees or train(docs))
    return out.select(F.col("key").alias("doc_id"), (fold(F.col("key"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, trees: Trees | None = None, reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of `docs` that are text of a learned language, all their columns. Rows with equal doc_id are judged one by one."""
    trees = trees or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def verdict():
        trees = shared.value
        return lambda data, offsets: code_lengths(trees, data, offsets).min(1) <= reject_bits * np.diff(offsets) if trees.langs else np.ones(len(offsets) - 1, bool)

    return kept_rows(docs.where(F.col("text").rlike(r"\p{L}")), verdict)
