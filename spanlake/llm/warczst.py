"""WARC archives compressed by Zstandard, one frame a record, with the dictionary in a leading skippable frame.

Archives are written as bytes, each of a bounded number of records, and read back frame by frame. A table of archives can lie in any
store that Spark reads; files of the same bytes are read by `open_archives`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import stored
from spanlake.llm.simhash import BROADCAST_ROWS, looked_up

#: Magic numbers of a skippable frame (for dictionaries in WARC archives) and of a Zstandard frame and dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Bytes of records before compression, of records that a dictionary is trained on, and of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 32 << 10
#: Payloads of fewer bytes are never turned into revisits.
MIN_REVISIT = 0
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class BadArchive(ValueError):
    """An archive that doesn't hold to the format, with the place where it fails."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record; a revisit holds HTTP headers only, and the full payload's digest and length in its own headers."""
    block = HTTP if revisit else HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "urn:none").split())), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records' frames after a dictionary trained on the first of them; where too few are there to train on, their text is the dictionary."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample += [r[i : i + 4096] for i in range(0, len(r), 4096)]
        size += len(r)
    try:
        known = zs.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zs.ZstdError:
        known = b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1"
    packed = zs.ZstdCompressor(level=9).compress(known)
    writer = zs.ZstdCompressor(level=3, dict_data=zs.ZstdCompressionDict(known), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(writer.compress, records)])


def _dictionary(data: memoryview) -> tuple[zs.ZstdCompressionDict | None, int]:
    """The leading skippable frame's dictionary, itself compressed or not, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    (n,) = struct.unpack_from("<I", data, 4)
    if 8 + n > len(data):
        raise BadArchive("the dictionary's frame is cut off")
    known = bytes(data[8 : 8 + n])
    if known[:4] == struct.pack("<I", FRAME):
        known = zs.ZstdDecompressor().decompress(known)
    return zs.ZstdCompressionDict(known), 8 + n


def frames(data: bytes) -> Iterator[bytes]:
    """One decoded frame after the other; other skippable frames are passed over."""
    view = memoryview(data)
    known, at = _dictionary(view)
    reader = zs.ZstdDecompressor(dict_data=known) if known else zs.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise BadArchive(f"cut off at byte {at}")
        magic, n = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + n
            continue
        one, parts, fed = reader.decompressobj(), [], at
        try:
            while not one.eof:
                if fed >= len(view):
                    raise BadArchive(f"the frame at byte {at} is cut off")
                parts.append(one.decompress(view[fed : fed + (1 << 14)]))
                fed = min(fed + (1 << 14), len(view))
        except zs.ZstdError as e:
            raise BadArchive(f"the frame at byte {at}: {e}") from e
        at = fed - len(one.unused_data)
        yield b"".join(parts)


def parse(frame: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-cased name, and block of the one record in a frame, checked against each other."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1") or not gap:
        raise BadArchive(f"no WARC record: {version[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"{name} is missing")
    if headers["warc-type"] not in TYPES:
        raise BadArchive(f"unknown type {headers['warc-type']!r}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise BadArchive("Content-Length is no number")
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    if (wanted := headers.get("warc-block-digest")) and wanted.partition(":")[2] != digest(rest[:n]):
        raise BadArchive("the block doesn't match its digest")
    return headers, rest[:n]


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """A table of archives (archive binary, n_records) of all rows of `pages` (page_id, url, html).

    Of rows with equal payloads (null html: empty) of at least `min_revisit` bytes, those with the largest page_id are responses and the others
    revisits of it; a null page_id is smaller than any other, and rows that share the largest are all responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # which pages revisit which is told by page_id and digest alone; pages wait for that where they are, or are dealt out by both
    thin = stored(own.where(F.octet_length("html") >= min_revisit).select("page_id", "sha1"), "digests")
    shared = stored(thin.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "shared")
    again = looked_up(thin, shared, "sha1", thin.count()).where(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull())
    again = stored(again.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), F.col("last").alias("refers_to")).distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1"))
    both = own.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, same, "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(records):
            return pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary()), pa.array([len(records)], pa.int64())], names=["archive", "n_records"])

        records, size = [], 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(k).to_pylist() for k in range(4))):
                records.append(record(page_id, url, html.encode(), refers_to, refers_to is not None))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield closed(records)
                    records, size = [], 0
        if records:
            yield closed(records)

    return both.mapInArrow(run, "archive binary, n_records long")


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files *.warc.zst as a table of archives."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive"), "path")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives of column `archive`; null archives have none. Raises BadArchive for what isn't valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "page_id", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, size = [], 0
        for b in batches:
            for data in b.column(0):
                if not data.is_valid:
                    continue
                for frame in frames(data.as_py()):
                    h, block = parse(frame)
                    whole = h["warc-type"] == "response" or h["warc-type"] == "revisit"
                    payload = block.partition(b"\r\n\r\n")[2] if whole and h.get("content-type", "").startswith("application/http") else block
                    said = h.get("warc-payload-digest", "").partition(":")[2] or digest(payload)
                    if h["warc-type"] != "revisit" and said != digest(payload):
                        raise BadArchive(f"the payload of {h['warc-record-id']} doesn't match its digest")
                    n = int(h.get("x-payload-length", len(payload)))
                    if h["warc-type"] != "revisit" and n != len(payload):
                        raise BadArchive(f"the payload of {h['warc-record-id']} has {len(payload)} bytes, not {n}")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"), number("x-page-id"), payload, n, said, number("x-refers-to-page-id")))
                    size += len(payload)
                    if size >= 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    return archives.select("archive").mapInArrow(run, "record_id string, record_type string, url string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page: archives of all pages are written to the shared folder and read from there. An empty table has no archive and gives no rows."""
    back = read_archives(stored(write_archives(pages), "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
