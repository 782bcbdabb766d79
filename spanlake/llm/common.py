"""Helpers shared by the text operators: Arrow buffers as numpy arrays, shared folders, held-out folds."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; bounds the size of the numpy arrays, not the length of a text.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
#: Column that numbers the rows of a written table.
ROW = "__spanlake_row"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets one of its own;
    on a cluster that is an error, since executors don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, and later readers scan only what they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanlake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def thinned(key: Column, share: Column | float) -> Column:
    """Whether a key is among a share of all keys, by its hash: what is left of a large table before a sample of bounded size is ordered."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) < F.least(F.lit(share) if isinstance(share, float) else share, F.lit(1.0)) * (1 << 31)


def excerpt(text: Column, most: int, pieces: int = 8) -> Column:
    """The text, or of one over `most` bytes so many pieces of equal length, evenly spread over all of it."""
    size = most // (2 * pieces)  # characters; few take more than two bytes on average
    step = (F.length(text) - size) / (pieces - 1)
    parts = (F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(pieces))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat_ws("\n", *parts))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column, without copying; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows that hold about `most` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = last


def stretches(data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """The offsets, with more between them where a text is longer than `most` bytes: each before a white-space character (space, \\n or \\t), if there is one."""
    long = np.flatnonzero(np.diff(offsets) > most)
    cuts = [offsets]
    for k in long.tolist():
        a, b = int(offsets[k]), int(offsets[k + 1])
        while b - a > most:
            part = data[a + 1 : a + most]
            gap = np.flatnonzero((part == 32) | (part == 10) | (part == 9))
            if not len(gap):
                step = 1 << 20
                a += most
                while a < b and not len(gap):  # a word longer than a stretch stays whole
                    gap = np.flatnonzero((data[a : min(a + step, b)] == 32) | (data[a : min(a + step, b)] == 10))
                    a += int(gap[0]) if len(gap) else step
                if not len(gap):
                    break
            else:
                a += 1 + int(gap[-1])
            cuts.append(np.array([a]))
    return np.sort(np.concatenate(cuts)) if len(cuts) > 1 else offsets


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have Spark pass texts to Python workers in Arrow batches of at most so many bytes, so that a task's memory doesn't follow the length of texts.

    Lowers spark.sql.execution.arrow.maxBytesPerBatch of the session, which is read when a query starts; a lower setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).lower())
    if not now or int(now[1]) << 10 * " kmgt".index(now[2] or " ") > most:
        spark.conf.set(key, str(most))


def sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` along the first axis; empty runs give 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def kept_rows(docs: DataFrame, verdict) -> DataFrame:
    """The rows of `docs`, with all their columns, for which `verdict(bytes, offsets)` of column text is true; a null text counts as empty.

    verdict: made on a worker by calling the argument once, so that what it sets up is set up once a task.
    """
    at = docs.columns.index("text")

    def run(batches):
        judge = verdict()
        for b in batches:
            yield b.filter(pa.array(judge(*utf8(b.column(at))), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BYTE[[32, *range(9, 14)]] = 0  # white space adds nothing to a word's hash
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits spread over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the texts, one text after the other, and where each text's words begin (and the last one's end).

    Words keep nothing but their hash, and bytes are taken a stretch at a time, so a long text needs eight bytes a word.
    """
    parts, bounds = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64)
    fine = stretches(data, offsets, CHUNK_BYTES)
    owner = np.minimum(np.searchsorted(offsets, fine[:-1], side="right"), max(1, len(offsets) - 1)) - 1  # where texts are empty, the last that begins there
    counts = np.zeros(len(offsets) - 1, np.int64)
    for i, j in chunks(fine):
        a, b = int(fine[i]), int(fine[j])
        part = data[a:b]
        if not len(part):
            continue
        space = (part == 32) | ((part >= 9) & (part <= 13))
        first = ~space
        edge = fine[i:j] - a
        edge = edge[edge < len(part)]
        held = first[edge]
        first[1:] &= space[:-1]
        first[edge] = held  # a text begins a word even where the one before ends in one
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        spot = np.arange(len(part))
        spot[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(part)))
        spot[space] = 0
        powers = np.cumprod(np.full(int(spot.max()) + 1, _BASE))
        parts.append(mixed(np.add.reduceat(_BYTE[part] * powers[spot], starts)))
        at = np.searchsorted(starts, np.append(fine[i:j] - a, len(part)))
        np.add.at(counts, owner[i:j], np.diff(at))
    bounds[1:] = np.cumsum(counts)
    return np.concatenate(parts), bounds
