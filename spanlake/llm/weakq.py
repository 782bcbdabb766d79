"""Text quality by weak supervision.

Ten rules vote good or bad, or abstain, on counts taken from the whole text. Expectation-maximisation over the
patterns of votes, of which there are 3^10 at most whatever the input, estimates how often each rule is right about good and about
bad texts; a text is kept if the posterior probability that it is good reaches a threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import chunks, small_batches, stored, sums, utf8

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(b"""the of and to in is that it for was on are as with be by this have from or
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch
de la le et les des en un du une que est pour qui dans par plus pas au sur
el los se las del con por para no es lo una su al""".split())
#: A word takes part in a repetition if it stands in a window of so many words that occurs twice or more.
WINDOW = 3
KEEP = 0.5
#: Chances that a rule abstains, votes good and votes bad, to begin with, of good and of bad texts, and the texts that this knowledge is worth.
PRIOR, PRIOR_TEXTS = ((0.48, 0.50, 0.02), (0.45, 0.25, 0.30)), 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_function", "n_distinct", "n_letters", "n_upper", "n_wordlike", "n_latin")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_START = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC3)

#: Letters of the scripts that FUNCTION_WORDS are written in: ASCII and U+00C0 to U+024F.
_LATIN = _LETTER & ((np.arange(256) < 128) | (np.arange(256) <= 0xC9))
#: What ends a sentence, also in Arabic, Devanagari, Chinese and Japanese.
_ENDS = tuple(x.encode() for x in (".", "!", "?", '"', ":", "\u061f", "\u0964", "\u3002", "\uff01", "\uff1f", "\u2026", "\u201d", "\u00bb"))


def repeated(words: list[bytes]) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit[i : i + WINDOW] = b"\1" * WINDOW
    return sum(hit)


def line_counts(text: bytes) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier line; those that end like a sentence."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines)), sum(x.rstrip().endswith(_ENDS) for x in lines)


def count(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row of `docs` (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            flat = []
            for i, j in chunks(offsets):
                d, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                where = at[:-1], np.diff(at)
                flat.append([sums(table[d], *where) for table in (_START & ~_SPACE, _SYMBOL, _LETTER & _START, _UPPER, _LATIN)])
            chars, symbols, letters, upper, latin = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (zip(*flat) if flat else ((), (), (), (), ())))
            rows = []
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                words = text.split()
                kinds = {w.lower() for w in words}
                rows.append((len(words), repeated(words), *line_counts(text), len(kinds & FUNCTION_WORDS), len(kinds), sum(not w.isascii() or w.strip(b".,;:!?\"'()").isalpha() for w in words)))
            n_words, rep, lines, dup, ended, function, distinct, wordlike = np.array(rows, np.int64).reshape(-1, 8).T
            columns = (n_words, chars, symbols, dup, rep, lines, ended, function, distinct, letters, upper, wordlike, latin)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], schema=SCHEMA)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes good and when bad; it abstains otherwise. All read the columns of `count`.

    Rules for faults only ever vote bad: that a text isn't all capitals says little for it. A text that isn't mostly in Latin letters isn't asked for function words.
    """
    c, never = F.col, F.lit(False)
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda x: c(x) / F.greatest(c("n_lines"), F.lit(1))
    some = c("n_words") >= 10
    return {
        "length": (c("n_words") >= 100, c("n_words") < 50),
        "function_words": (c("n_function") >= 3, some & (c("n_function") == 0) & (2 * c("n_latin") > c("n_letters"))),
        "sentences": (per_line("n_ended") >= 0.5, per_line("n_ended") < 0.1),
        "word_length": (never, (per_word("word_chars") < 2.2) | (per_word("word_chars") > 14)),
        "symbols": (never, per_word("n_symbols") > 0.1),
        "duplicate_lines": (never, per_line("n_dup_lines") > 0.3),
        "repetition": (never, per_word("n_repeat_words") > 0.3),
        "capitals": (never, c("n_upper") > 0.5 * F.greatest(c("n_letters"), F.lit(1))),
        "wordlike": (never, per_word("n_wordlike") < 0.7),
        "variety": (never, some & (per_word("n_distinct") < 0.25)),
    }


def pattern() -> Column:
    """All votes as one number: a digit of base 3 a rule, 0 abstains, 1 good, 2 bad."""
    return sum((F.when(good, 1).when(bad, 2).otherwise(0) * 3**k for k, (good, bad) in enumerate(rules().values())), F.lit(0)).cast("int")


def posteriors(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each pattern, and for each rule the chances of abstaining, voting good and voting bad, for good and for bad texts.

    Each rule starts from PRIOR, which stays worth PRIOR_TEXTS texts: a bad vote is rare on good texts.
    """
    n = len(rules())
    votes = patterns[:, None] // 3 ** np.arange(n) % 3
    one_hot = np.stack([votes == k for k in range(3)], 2).astype(float)  # pattern, rule, vote
    prior = np.repeat(np.array(PRIOR)[:, None], n, axis=1)  # class, rule, vote
    chance, share = prior.copy(), 0.8
    p = np.full(len(patterns), share)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", one_hot, np.log(chance[0]) - np.log(chance[1]))
        last, p = p, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for k, w in enumerate((weights * p, weights * (1 - p))):
            chance[k] = (np.einsum("p,prv->rv", w, one_hot) + PRIOR_TEXTS * prior[k]) / (w.sum() + PRIOR_TEXTS)
        share = (weights @ p + 0.8 * PRIOR_TEXTS) / (weights.sum() + PRIOR_TEXTS)
        if np.abs(p - last).max(initial=0) < 1e-9:
            break
    return p, chance


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The counts, posterior and verdict of every row of `docs`.

    base_failed: under 50 words, or over half of the words in repetitions. A null or empty text fails. Rows with equal or null doc_id are judged one by one, equal
    texts alike. A long text takes memory for its words. No rows give none.
    """
    spark = docs.sparkSession
    counted = stored(count(docs).withColumn("pattern", pattern()), "weakq")
    found = counted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3^10 rows at most
    p, _ = posteriors(np.array([r.pattern for r in found], np.int64), np.array([r.n for r in found], float))
    table = spark.createDataFrame([(r.pattern, float(x)) for r, x in zip(found, p)], "pattern int, posterior double")
    out = counted.join(F.broadcast(table), "pattern", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("posterior") >= keep)
    return out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), kept.alias("kept"), "posterior")
