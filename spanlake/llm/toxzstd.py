"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart on a bounded sample of labelled rows: one on ordinary texts, one on toxic texts. The toxic one is
then pruned by compression: a word of it stays if windows of toxic texts that it shortens, beside the ordinary dictionary, are in clearly more texts
than those of ordinary texts. A text is cut into windows of six words; each window is compressed with the ordinary dictionary alone and
with the toxic one behind it, so that both know ordinary language equally well. How many windows get how much shorter, calibrated by logistic regression on the
same sample, gives the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import excerpt, fold, kept_rows, small_batches, thinned, utf8

#: Bounds of the labelled sample: rows of either class, and bytes of a text; of a longer text pieces spread over all of it are taken.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = {1: 1500, 0: 4000}, 32_768
#: Words of a window.
WORDS = 6
ORDINARY_BYTES, TOXIC_BYTES = 131_072, 131_072
#: Bytes of a training sample for a dictionary (longer texts give several), and the lengths of what the trainer selects and counts.
PIECE, SEGMENT, COUNTED = 2048, 16, 6
#: A word of the toxic dictionary stays if it shortens, by SAVED bytes at least, windows of so many toxic texts; if the share of ordinary texts is at most so much
#: of the share of toxic ones; and if the likelihood ratio of the two shares is so large.
SAVED, LEAST_TEXTS, SHARE, RATIO = 2, 4, 0.3, 12.0
#: zstandard doesn't search the last bytes of a dictionary; this goes there.
PADDING = b" " * 16
THRESHOLD = 0.3

SCHEMA = pa.schema([("key", pa.int64()), ("score", pa.float64())])


def compressor(dictionary: bytes):
    """Compresses with the content of a dictionary and as little frame around it as possible."""
    how = zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=1, min_match=5, target_length=1, strategy=zs.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zs.ZstdCompressor(compression_params=how, dict_data=zs.ZstdCompressionDict(dictionary + PADDING, dict_type=zs.DICT_TYPE_RAWCONTENT)).compress


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]

    def compressors(self) -> list:
        return [compressor(self.ordinary), compressor(self.ordinary + self.toxic)]


def windows(text: bytes) -> list[bytes]:
    """The lower-cased words (A-Z), so many at a time, a space around each."""
    w = text.lower().split()
    return [b" %b " % b" ".join(w[i : i + WORDS]) for i in range(0, len(w), WORDS)]


def savings(text: bytes, compressors) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    ordinary, both = compressors
    return np.array([len(ordinary(x)) - len(both(x)) for x in windows(text)], np.int64)


def features(saved: np.ndarray) -> list[float]:
    """A constant, the largest saving, shares and numbers of windows that save at least 2, 4 and 6 bytes, the number of windows, and the sum saved."""
    n = len(saved)
    if not n:
        return [1.0] + [0.0] * 9
    over = [np.count_nonzero(saved >= k) for k in (2, 4, 6)]
    return [1.0, min(int(saved.max()), 16) / 4, *(math.sqrt(x / n) * 3 for x in over), *(math.log1p(x) for x in over), math.log1p(n) / 4, min(math.log1p(max(int(saved.sum()), 0)), 6) / 2]


def probability(weights, x) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x) @ np.asarray(weights), -30, 30)))


def _fresh(texts: list[bytes]) -> list[bytes]:
    """Without copies and near copies, so that a text that was copied often doesn't pass for a habit of its class."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.split()
        marks = {k for i in range(len(w) - 3) if (k := zlib.crc32(b" ".join(w[i : i + 4]))) % 4 == 0} or {zlib.crc32(t)}
        if len(marks & seen) <= 0.3 * len(marks):
            seen |= marks
            out.append(t)
    return out


def dictionary(size: int, texts: list[bytes]) -> bytes:
    """Trained by zstandard; too few texts for that: their most frequent words, the commonest last."""
    try:
        return zs.train_dictionary(size, [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)], k=SEGMENT, d=COUNTED).as_bytes()
    except zs.ZstdError:
        return b" ".join(s for s, _ in reversed(Counter(w for t in texts for w in t.split()).most_common()))[-size:] or b" "


def pruned(toxic: bytes, ordinary: bytes, texts: dict[int, list[bytes]]) -> bytes:
    """The words of the toxic dictionary that shorten windows of toxic texts (texts[1]) rather than of ordinary ones (texts[0]), the surest last."""
    begun = COUNTED  # a word shortens only windows with a word that begins like it
    found: dict[bytes, list[tuple[int, int, bytes]]] = defaultdict(list)
    for y in (1, 0):
        for k, t in enumerate(texts[y]):
            for x in windows(t):
                for start in {(b" %b " % w)[:begun] for w in x.split()}:
                    found[start].append((y, k, x))
    n = {y: max(1, len(texts[y])) for y in (0, 1)}
    alone, lengths = compressor(ordinary), {}
    kept = []
    for word in sorted({b" %b " % w for w in toxic.split()[1:-1]}):
        near = found.get(word[:begun], ())
        most = {y: len({k for z, k, _ in near if z == y}) for y in (0, 1)}
        if most[1] < LEAST_TEXTS or most[0] * n[1] > 2 * SHARE * most[1] * n[0]:
            continue
        both, hit = compressor(ordinary + word), {0: set(), 1: set()}
        for y, k, x in near:
            if x not in lengths:
                lengths[x] = len(alone(x))
            if lengths[x] - len(both(x)) >= SAVED:
                hit[y].add(k)
        one, none = len(hit[1]), max(len(hit[0]), 0.5)
        if one >= LEAST_TEXTS and none * n[1] <= SHARE * one * n[0]:
            all_ = (one + none) / (n[0] + n[1])
            ratio = 2 * (one * math.log(one / n[1] / all_) + none * math.log(none / n[0] / all_))
            if ratio >= RATIO:
                kept.append((ratio, word))
    return b"".join(w[:-1] for _, w in sorted(kept))[-TOXIC_BYTES:]


def fit(rows: list[tuple[int, str]], counts: dict[int, int] | None = None) -> Model:
    """From (label, text) pairs; counts: labelled rows of either class, so that the sample's share of it doesn't bias the scores. Equal rows count once
    for the dictionaries; without toxic rows nothing is saved anywhere."""
    rows = sorted(rows, key=lambda r: (r[0], zlib.crc32(r[1].encode()), r[1]))  # in an order that doesn't depend on how they were gathered
    texts = {y: _fresh([b" ".join([b"", *t.encode().lower().split(), b""]) for label, t in rows if label == y]) for y in (0, 1)}
    ordinary = dictionary(ORDINARY_BYTES, texts[0])
    model = Model(ordinary, pruned(dictionary(TOXIC_BYTES, texts[1]), ordinary, texts), [])
    both = model.compressors()
    x = np.array([features(savings(t.encode(), both)) for _, t in rows] or [features(np.zeros(0))])
    y = np.array([label for label, _ in rows] or [0.0], float)
    own = {k: max(1, (y == k).sum()) for k in (0, 1)}
    each = np.where(y == 1, *((counts or own).get(k, 0) / own[k] for k in (1, 0)))
    each *= len(y) / max(each.sum(), 1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a small ridge
        p = probability(w, x)
        w += np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (each * (y - p)) - 1e-2 * w)
    return Model(model.ordinary, model.toxic, w.tolist())


def sample(docs: DataFrame, labels: DataFrame, counts: dict[int, int], rows: dict = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(toxic, text) of at most `rows` labelled texts of either class, chosen by a hash of their doc_id; of a text over `text_bytes` pieces from all of it.
    counts: labelled rows of either, so that only some four times the sample is ordered."""
    share = F.when(F.col("toxic") == 1, 4.0 * rows[1] / max(1, counts.get(1, 0))).otherwise(4.0 * rows[0] / max(1, counts.get(0, 0)))

    def first(df: DataFrame, *ties: Column) -> DataFrame:
        parts = (df.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", *ties).limit(n) for y, n in rows.items())
        return reduce(DataFrame.unionByName, parts)

    picked = first(labels.where(thinned(F.col("doc_id"), share)).select("doc_id", "toxic"))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return first(found, F.xxhash64("text")).select("toxic", excerpt(F.col("text"), text_bytes).alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows outside the held-out fold (crc32 mod 4 = 2); labels other than 0 and 1 are left out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit([(r.toxic, r.text) for r in sample(docs, own, counts).collect()], counts)


def scores(model: Model, compressors, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x = [features(savings(data[a:b].tobytes(), compressors)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return probability(model.weights, x) if x else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text; other columns are ignored).

    A null text counts as empty, and all empty texts score alike. Rows with equal or null doc_id are scored one by one; a repeated row gets the same score. A long
    text is read in windows and needs no more memory than they do. Without labels of both classes the score says no more than their share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value.compressors()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(shared.value, both, *utf8(b.column(1))))], schema=SCHEMA)

    small_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(run, "key long, score double")
    out = scored.select(F.col("key").alias("doc_id"), (fold(F.col("key"), 4) == 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score under the threshold, all their columns; null and empty texts score as `classify` has them."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def verdict():
        both = shared.value.compressors()
        return lambda data, offsets: scores(shared.value, both, data, offsets) < threshold

    return kept_rows(docs, verdict)
