"""Fill-in-middle by secondary sort.

Each text is cut at two unit boundaries into prefix, middle and suffix, and sent as bounded pieces keyed by document and place in the output. Partitions
sorted by that key (`repartition` and `sortWithinPartitions`, which move and sort as repartitionAndSortWithinPartitions does, without Python objects in the
shuffle) stream each output piece by piece, into a file, a string or an incremental digest. Sorted once more by the place that the markers and the form tell,
the same pieces of the same partition stream the restored text. No document is held whole after it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import small_batches, utf8

#: The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes after which a piece ends at the next unit, and bytes of a batch of pieces.
PIECE_BYTES, OUT_BYTES = 1 << 16, 4 << 20
SECTIONS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
END = 3 << 40
_HEADER = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_HEADER_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Choice:
    """seed goes before doc_id into the digest that decides; so many percent of the texts are rearranged, and so many of these suffix first."""

    seed: str = "1"
    percent: int = 90
    suffix_first: int = 20


def draws(doc_id: int | None, seed: str) -> list[int]:
    """The first four groups of eight digits of the hex digest; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where a unit of `[A-Za-z]+|[^A-Za-z]` begins, as a flag for each byte of the one text."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def byte_of(starts: np.ndarray, unit: int) -> int:
    """The byte where that unit begins, the end if there is none; goes over the flags a stretch at a time."""
    for a in range(0, len(starts), PIECE_BYTES):
        here = int(np.count_nonzero(starts[a : a + PIECE_BYTES]))
        if unit < here:
            return a + int(np.flatnonzero(starts[a : a + PIECE_BYTES])[unit])
        unit -= here
    return len(starts)


def _pieces(data: np.ndarray, starts: np.ndarray, a: int, b: int) -> Iterator[bytes]:
    """The bytes from a to b in pieces that end before a unit."""
    while a < b:
        end = a + PIECE_BYTES
        while end < b and not starts[end]:
            step = np.flatnonzero(starts[end : min(end + PIECE_BYTES, b)])
            end += int(step[0]) if len(step) else PIECE_BYTES
        yield data[a : min(end, b)].tobytes()
        a = end


def rearranged(data: np.ndarray, doc_id: int | None, choice: Choice) -> tuple[tuple, Iterator[bytes]]:
    """What the header says (n, form, prefix_chars, middle_chars) and the pieces of the output, markers apart."""
    starts = unit_starts(data)
    n = int(np.count_nonzero(starts))
    h1, h2, h3, h4 = draws(doc_id, choice.seed)
    text = data.tobytes()
    if not n or h3 % 100 >= choice.percent or any(m in text for m in SECTIONS):
        return (n, "plain", None, None), _pieces(data, starts, 0, len(data))
    a, b = (byte_of(starts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = lambda i, j: int(np.count_nonzero((data[i:j] & 0xC0) != 0x80))
    form = "spm" if h4 % 100 < choice.suffix_first else "psm"
    ends = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(data))}

    def out():
        for m in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
            yield m
            yield from _pieces(data, starts, *ends[m])

    return (n, form, chars(0, a), chars(a, b)), out()


def pieces(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """The outputs of all rows of `docs` (doc_id, text) as pieces: row (a number of its own for each row), place, piece; place 0 has doc_id, n, form,
    prefix_chars and middle_chars and is empty. Rows are numbered as they are scanned: `docs` should be a table as it is read, or written first."""
    schema = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("piece", pa.binary()), *_HEADER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            data, at = utf8(b.column(2))
            for row, doc_id, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at.tolist(), at[1:].tolist()):
                head, parts = rearranged(data[i:j], doc_id, choice)
                out.append((row, 0, b"", doc_id, *head))
                for place, part in enumerate(parts, 1):
                    out.append((row, place, part, None, None, None, None, None))
                    size += len(part)
                    if size > OUT_BYTES:
                        yield _batch(schema, out)
                        out, size = [], 0
            if out:
                yield _batch(schema, out)
                out, size = [], 0

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, place long, piece binary, {_HEADER_SQL}")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def _batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """`rows`, whose third value is a piece, in batches of bounded bytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[2] or b"") + 100
        if size > OUT_BYTES:
            yield _batch(schema, out)
            out, size = [], 0
    if out:
        yield _batch(schema, out)


def outputs(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """doc_id, form and the whole output of each row, for texts that a task can hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.binary())])

    def rows(batches):
        head, parts = None, []
        for _, place, piece, doc_id, _, form, *_ in _streamed(batches):
            if place == 0:
                if head:
                    yield *head, b"".join(parts)
                head, parts = (doc_id, form), []
            parts.append(piece)
        if head:
            yield *head, b"".join(parts)

    return _in_order(pieces(docs, choice)).mapInArrow(lambda batches: _batches(schema, rows(batches)), "doc_id long, form string, output binary").withColumn("output", F.col("output").cast("string"))


def digests(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text that is restored from the output and its form.

    Null and empty texts are plain and empty; a null doc_id counts as no digits; rows that repeat a doc_id, or a whole row, are rows of their own;
    further columns are ignored; an empty table gives none.
    """
    told = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("piece", pa.binary()), *_HEADER, ("output_sha256", pa.string())])
    said = pa.schema([*_HEADER, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come in the order of the output; each goes on with its place in the text, and a document's last row has the output's digest."""

        def rows():
            head = None
            for row, place, piece, *more in _streamed(batches):
                if place == 0:
                    if head:
                        yield head[0], END, None, *head[1], whole.hexdigest()
                    head, whole, section = (row, more), hashlib.sha256(), 0
                    continue
                whole.update(piece)
                if head[1][2] != "plain" and piece in SECTIONS:
                    section = SECTIONS[piece]
                else:
                    yield row, section << 40 | place, piece, None, None, None, None, None, None
            if head:
                yield head[0], END, None, *head[1], whole.hexdigest()

        return _batches(told, rows())

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            whole = hashlib.sha256()
            for _, place, piece, *more in _streamed(batches):
                if place < END:
                    whole.update(piece)
                else:
                    yield *more, whole.hexdigest()
                    whole = hashlib.sha256()

        done = []
        for r in rows():
            done.append(r)
            if len(done) == 1 << 12:
                yield _batch(said, done)
                done = []
        if done:
            yield _batch(said, done)

    sent = _in_order(pieces(docs, choice)).mapInArrow(out, f"row long, place long, piece binary, {_HEADER_SQL}, output_sha256 string")
    return sent.sortWithinPartitions("row", "place").mapInArrow(back, f"{_HEADER_SQL}, output_sha256 string, restored_sha256 string")
