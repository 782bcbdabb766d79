"""Packing by power-of-two decomposition.

A document of n tokens is cut, in order, into pieces of the window's length and then one piece for each set bit of the rest, the
largest first. Each piece is a sequence of its own and its length a power of two, so that no sequence crosses documents and
none is padded; sequences of equal length form a bucket for batching.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import chunks, small_batches, stretches, utf8

WINDOW, END = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a worker keeps, beside those of one chunk; beyond that it forgets the rarer ones.
KEPT = 300_000
#: Bytes of text that are tokenized at once.
CHUNK = 1 << 21

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids array<int>"

#: How the vocabulary that `Words` knows prepares a text and cuts it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each ASCII byte, and of each character from U+0080 to U+00FF; OTHER is left to the tokenizer."""
    ascii_ = np.full(256, MARK, np.uint8)
    ascii_[[*range(9), *range(14, 32), *range(127, 256)]] = OTHER
    ascii_[[*range(9, 14), 32]] = SPACE
    ascii_[[*range(48, 58)]] = DIGIT
    ascii_[[*range(65, 91), *range(97, 123)]] = LETTER
    latin = np.full(128, MARK, np.uint8)
    latin[: 0xA0 - 0x80] = OTHER
    latin[0xA0 - 0x80] = SPACE
    latin[[ord(c) - 0x80 for c in "ªµº"]] = LETTER
    latin[[ord(c) - 0x80 for c in "²³¹¼½¾"]] = DIGIT
    latin[0xC0 - 0x80 :] = LETTER
    latin[[ord(c) - 0x80 for c in "×÷"]] = MARK
    return ascii_, latin


_ASCII, _LATIN = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary's words in the stretches data[at[i]:at[i + 1]], dictionary-encoded; the words of each stretch; and which stretches
    have characters beyond Latin-1, controls or what may be a special token: these have no words here."""
    d = _LOWER[data[at[0] : at[-1]]]
    at = at - at[0]
    kind = _ASCII[d]
    lead = np.flatnonzero((d == 0xC2) | (d == 0xC3))
    if len(lead):
        follow = d[lead + 1]
        char = (d[lead] - 0xC2) * 64 + (follow - 0x80)
        kind[lead] = kind[lead + 1] = _LATIN[char]
        upper = (char >= 0x40) & (char < 0x5F) & (char != 0x57)
        d[lead[upper] + 1] += 32
    other = np.concatenate([np.flatnonzero(kind == OTHER), k[d[k + 1] == 124] if len(k := np.flatnonzero(d[:-1] == 60)) else k])
    odd = np.zeros(len(at) - 1, bool)
    odd[np.searchsorted(at, other, side="right") - 1] = True
    for i in np.flatnonzero(odd):
        kind[at[i] : at[i + 1]] = SPACE
    start = np.empty(len(d), bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    start[at[:-1][at[:-1] < len(d)]] = True
    digits = np.flatnonzero(kind == DIGIT)
    start[digits] = (d[digits] & 0xC0) != 0x80
    quotes = np.flatnonzero((d == 39) & start)
    if len(quotes):
        room = at[np.searchsorted(at, quotes, side="right")]
        for c in CONTRACTIONS:
            hit = quotes[quotes + len(c) < room]
            for k, letter in enumerate(c.encode(), 1):
                hit = hit[d[hit + k] == letter]
            start[hit + 1] = False
            after = hit + len(c) + 1
            start[after[after < len(d)]] = True
    solid = kind != SPACE
    start &= solid
    first = np.flatnonzero(start)
    place = np.cumsum(solid)
    total = int(place[-1]) if len(place) else 0
    offsets = np.append(place[first] - 1, total).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(d[solid])])
    return words.dictionary_encode(), np.diff(np.searchsorted(first, at)), odd


class Ids:
    """Token ids of whole texts, as the tokenizer gives them.

    The vocabulary marks the ends of words and codes each word alone, so each distinct word is coded once and its ids are kept. A tokenizer
    that cuts text in another way than PATTERN gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        how = json.loads(Path(path).read_text())
        before, special = how["pre_tokenizer"] or {}, [x["content"] for x in how["added_tokens"]]
        self.by_word = (how["normalizer"] or {}).get("normalizers") == NORMALIZERS and how["model"].get("end_of_word_suffix") == "</w>"
        self.by_word &= [(x.get("pattern") or {}).get("Regex") for x in before.get("pretokenizers", ())] == [PATTERN, None] and all(x.startswith("<|") for x in special)
        if self.by_word:  # the same vocabulary for words that are lower-cased and cut already
            vocabulary = how["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            cut = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, before["pretokenizers"][1]]}
            self.words = Tokenizer.from_str(json.dumps(how | {"normalizer": None, "added_tokens": [], "pre_tokenizer": cut}))
            self.clear()

    def clear(self) -> None:
        self.known, self.uses = pa.array([], pa.binary()), np.zeros(0, np.int32)
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, words: pa.Array) -> None:
        """Ids of new words: coded in one text, where the end-of-word marks tell them apart."""
        texts = words.to_pylist()
        ids = np.array(self.words.encode_batch_fast([b" ".join(texts).decode()], add_special_tokens=False)[0].ids, np.int32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(texts):
            each = [self.encode(w.decode()) for w in texts]
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.known = pa.concat_arrays([self.known, words])
        self.uses = np.concatenate([self.uses, np.zeros(len(texts), np.int32)])

    def _forget(self) -> None:
        """Keep the words met most often, half of KEPT at most; older meetings count for less."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
        stay = stay[self.uses[stay] > 1]
        size = self.size[stay]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.at[stay] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.known, self.uses, self.size, self.at = self.known.take(pa.array(stay)), self.uses[stay] // 2, size, ends - size

    def _coded(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        distinct = words.dictionary
        if len(self.known) > KEPT:
            self._forget()
        number = pc.index_in(distinct, value_set=self.known)
        if number.null_count:
            number, new = number.fill_null(-1).to_numpy().copy(), pc.filter(distinct, pc.is_null(number))
            number[number < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(new)
        else:
            number = number.to_numpy()
        self.uses[number] += 1
        each = number[words.indices.to_numpy()]
        size = self.size[each]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[each] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[at[i]:at[i + 1]] one after the other, and where each text's begin. A text longer than CHUNK is cut at white
        space, which no word holds."""
        if not self.by_word:
            each = [self.encode(data[a:b].tobytes().decode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.cumsum([0, *map(len, each)])
        edges = stretches(data, at, CHUNK)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, j in chunks(edges, CHUNK):
            words, each, odd = words_of(data, edges[i : j + 1])
            coded, size = self._coded(words)
            n = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(each)])])
            if odd.any():
                pieces = np.split(coded, np.cumsum(n)[:-1])
                for k in np.flatnonzero(odd):
                    pieces[k] = self.encode(data[edges[i + k] : edges[i + k + 1]].tobytes().decode())
                    n[k] = len(pieces[k])
                coded = np.concatenate(pieces)
            ids.append(coded)
            counts.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), ends[np.searchsorted(edges, at)] if len(edges) > 1 else np.zeros(len(at), np.int64)


@lru_cache(1)
def _ids(path: str | None) -> Ids:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Ids(path)


def lengths(n: int, window: int = WINDOW) -> list[int]:
    """The pieces of n tokens."""
    rest = n % window
    return [window] * (n // window) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pieces(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of the pieces of texts of so many tokens, in order."""
    bits = 1 << np.arange(window.bit_length() - 2, -1, -1)
    parts = np.concatenate([(sizes // window)[:, None], (sizes[:, None] & bits) > 0], axis=1).astype(np.int64)  # how many of each length
    return np.repeat(np.arange(len(sizes)), parts.sum(1)), np.repeat(np.tile(np.concatenate([[window], bits]), len(sizes)), parts.ravel())


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each document: where it starts, its length (a power of two), its ids and their crc32, and the bucket (log2 of the length).

    with_ids: have the ids in the result. window must be a power of two. A null or empty text gives the piece [end]. Rows with equal or null doc_id
    are packed one by one; a long text takes memory for its ids. path: of the tokenizer's file; None takes the public one. No rows give no pieces.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets, CHUNK):
                found, at = ids.of(data, offsets[i : j + 1])
                total = np.diff(at) + 1
                flat = np.insert(found, at[1:], end)
                row, length = pieces(total, window)
                stop = np.cumsum(length)
                begin = stop - length
                start = begin - (np.cumsum(total) - total)[row]
                raw = memoryview(flat.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * begin).tolist(), (4 * stop).tolist())]
                columns = [b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row]), pa.array(np.log2(length).astype(np.int32))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])

    small_batches(docs.sparkSession)
    ddl = DDL if with_ids else DDL.removesuffix(", ids array<int>")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences under a folder for each length, so that a batch reads equal ones."""
    packed.write.partitionBy("bucket").parquet(path)


def report(docs: DataFrame, **how) -> DataFrame:
    """The pieces without their ids, as `pack` gives them: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket."""
    return pack(docs, with_ids=False, **how).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
