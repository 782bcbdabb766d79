"""Each text operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard as zs
from pyspark.sql import functions as F

from spanlake.llm import cmix, decontam, density, langid, licenses, pow2pack, simhash, toxzstd, warczst, weakq

WORDS = {"en": "the of and river stone walking thing house".split(), "de": "der die und straße häuser gehen schön licht".split(), "fr": "le la et forêt être chanson lumière déjà".split()}


def sentence(rng, lang="en", n=40):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "ing", "en", "s"]) for _ in range(n)) + "."


def crc(x, n):
    return zlib.crc32(str(x).encode()) % n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, "\n".join(sentence(rng, lang) for _ in range(1 + i % 4)), lang, f"src{i % 5}"))
    out += [(90, None, "en", "s"), (91, "", "en", "s"), (92, " \n\t ", None, "s"), (93, "!!! 123 ???", "en", "s"), (94, sentence(rng, "en", 60_000), "en", "s"), (95, out[3][1], out[3][2], "s"), (95, out[3][1], out[3][2], "s"), (None, out[4][1], out[4][2], None), (96, "Licensed under CC BY-NC 4.0.\nMIT License; GNU General Public License, version 3", None, "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, int(r[0] % 4 == 0)) for r in rows[:90]] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


# 1. language


def test_ppm_code_lengths_are_exact():
    train = [("a", "abracadabra"), ("a", "abba"), ("b", "bcbcbcd")]
    trees = langid.fit(train)

    def plain(lang, text):
        counts = defaultdict(Counter)
        for x, t in train:
            if x == lang:
                padded = "\0\0\0" + t
                for i in range(3, len(padded)):
                    for k in range(4):
                        counts[k, padded[i - k : i]][padded[i]] += 1

        def p(context, symbol, k):
            if k < 0:
                return 1 / 256
            c = counts[k, context[len(context) - k :]]
            n, d = sum(c.values()), len(c)
            if not n:
                return p(context, symbol, k - 1)
            return c[symbol] / (n + d) if c[symbol] else d / (n + d) * p(context, symbol, k - 1)

        padded = "\0\0\0" + text
        known = set("".join(t for _, t in train))
        padded = "".join(ch if ch in known else "\0" for ch in padded)
        return sum(-math.log2(p(padded[i - 3 : i], padded[i], 3)) for i in range(3, len(padded)))

    texts = ["abra", "", "bcd zzz", "a" * 50, "dcba"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.code_lengths(trees, data, at)
    want = [[plain(lang, t) for lang in trees.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_language(docs, rows, empty):
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs).collect()}
    assert len(got) <= len(rows)
    found = {r.doc_id: r for r in got.values()}
    for i in (90, 91, 92, 93):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    held = [r for r in rows[:90] if crc(r[0], 4) == 2]
    assert held and all(found[r[0]].lang_pred == r[2] and found[r[0]].held_out for r in held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identify(docs).count() == len(rows)
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} | {96} == {r[0] for r in rows} - {90, 91, 92, 93}


# 2. language model


@pytest.fixture(scope="module")
def small_model(spark):
    rng = random.Random(3)
    texts = [sentence(rng, "en", rng.randrange(60)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = cmix.count_words(df.withColumn("train", F.lit(True))).cache()
    counts = {bytes(r.word): r.n_train for r in words.collect()}
    hot = sorted(((w, c) for w, c in counts.items() if c > 3), key=lambda x: (-x[1], x[0]))
    return cmix.train(df, words, hot, 40, 60), texts, counts


def plain_coded(model, tree, tables, symbols, contexts, adapt):
    """One sequence, bit by bit, with plain numbers."""
    weights = cmix._weights(len(tables)).astype(float)
    own, total, k, width = [0.0] * len(weights), 0.0, 0, cmix.FIRST_BLOCK
    while k < len(symbols):
        block = range(k, min(k + width, len(symbols)) if adapt else len(symbols))
        steps, bits = [0.0] * len(weights), 0
        for i in block:
            for p in range(tree.first[symbols[i]], tree.first[symbols[i]] + tree.length[symbols[i]]):
                node, sign = int(tree.nodes[p]), int(tree.signs[p])
                found = [int(t[(((int(c[i]) ^ node * 0x85EBCA6B % 2**32) * 0x9E3779B1) % 2**32) >> (33 - len(t).bit_length())]) for t, c in zip(tables, contexts)]
                said = [float(tree.plain[node]), *(((x & 255) - 128) / 16 for x in found)]
                gate = (found[-2] >> 8) * 4 + (found[-1] >> 8)
                x = sum((weights[j][gate] + own[j]) * said[j] for j in range(len(said)))
                miss = 1 / (1 + math.exp(max(-20, min(20, x * sign))))
                total += math.log1p(-miss)
                bits += 1
                for j, v in enumerate(said):
                    steps[j] += miss * sign * v
        if adapt:
            own = [o + cmix.RATE * x / math.sqrt(bits) for o, x in zip(own, steps)]
        k, width = block[-1] + 1, min(2 * width, cmix.LAST_BLOCK)
    return total


def as_bytes(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_words_are_coded_as_bit_by_bit(small_model):
    model, texts, _ = small_model
    ids = {w.as_py(): k for k, w in enumerate(model.known)}
    new = [t.encode() for t in [*texts[:5], "", " \n", "unheard of words", "the " * 200, texts[1].upper() + " " + " ".join(texts)]]
    for chunk, group in ((cmix.CHUNK, cmix.GROUP), (30, 7)):
        old, (cmix.CHUNK, cmix.GROUP) = (cmix.CHUNK, cmix.GROUP), (chunk, group)
        symbols, sizes, _ = model.read(*as_bytes(new))
        got, at = model.score(symbols, sizes), 0
        cmix.CHUNK, cmix.GROUP = old
        for k, n in enumerate(sizes):
            own = symbols[at : at + n]
            assert [int(x) for x in own] == [*(ids.get(w, len(ids) + 1) for w in new[k].lower().split()), len(ids)]
            contexts = cmix.word_contexts(own, np.array([n]), len(model.known) + 2)
            assert math.isclose(got[k] * math.log(10), plain_coded(model, model.words, model.word_tables, own, contexts, True), rel_tol=1e-4)
            at += n


def test_contexts_don_t_cross_texts(small_model):
    model, texts, _ = small_model
    new = [t.encode() for t in texts[:6]] + [b""]
    together = model.score(*model.read(*as_bytes(new))[:2])
    assert np.allclose(together, [model.score(*model.read(*as_bytes([t]))[:2])[0] for t in new], rtol=1e-6)


def test_model_probabilities_sum_to_one(small_model):
    model = small_model[0]
    n = len(model.known)
    first = np.arange(n, dtype=np.int32)[:5]
    every = [np.array([*first, x], np.int32) for x in range(n + 2)]
    prefix = model.score(first, np.array([len(first)]))[0]
    total = sum(10 ** (model.score(x, np.array([len(x)]))[0] - prefix) for x in every)
    assert math.isclose(total, 1, rel_tol=1e-3)
    letters, sizes = cmix.spelling(pa.array([b"the", b""]))
    assert bytes(letters) == b"the  " and sizes.tolist() == [4, 1]
    got = cmix.coded(model.letters, model.letter_tables, letters, cmix.letter_contexts(letters, sizes), sizes, False)
    want = [plain_coded(model, model.letters, model.letter_tables, letters[:4], cmix.letter_contexts(letters[:4], sizes[:1]), False), plain_coded(model, model.letters, model.letter_tables, letters[4:], cmix.letter_contexts(letters[4:], sizes[1:]), False)]
    assert np.allclose(got, want, rtol=1e-4)
    bytes_ = np.concatenate([np.array([116, x], np.uint8) for x in range(256)])
    twos = cmix.coded(model.letters, model.letter_tables, bytes_, cmix.letter_contexts(bytes_, np.full(256, 2)), np.full(256, 2), False)
    one = np.array([116], np.uint8)
    assert math.isclose(np.exp(twos).sum(), math.exp(cmix.coded(model.letters, model.letter_tables, one, cmix.letter_contexts(one, np.array([1])), np.array([1]), False)[0]), rel_tol=1e-3)


def test_huffman_codes_by_counts():
    counts = np.array([50, 20, 20, 5, 4, 0], float)
    tree = cmix.huffman(counts)
    p = [math.exp(sum(-math.log1p(math.exp(-tree.plain[tree.nodes[k]] * tree.signs[k])) for k in range(tree.first[s], tree.first[s] + tree.length[s]))) for s in range(6)]
    assert np.allclose(p, np.maximum(counts, 0.5) / 99.5, rtol=1e-5)
    assert tree.length[0] == 1 and sum(2.0 ** -tree.length) == 1
    assert cmix.huffman(np.array([3.0])).length.tolist() == [0]


def test_held_out_texts_change_no_other_score(spark, rows, docs):
    """Words of held-out texts, however frequent, have no say in what the other texts cost."""
    other = [(*((r[0], "zyx vut the river " * 400) if r[0] is not None and crc(r[0], 7) == 2 else r[:2]),) for r in rows]
    changed = spark.createDataFrame(other, "doc_id long, text string")
    train = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.n_known, r.train_tokens, round(r.score, 6), round(r.base_score, 6)) for r in cmix.score_texts(df).where("not held_out").collect())
    assert sum(a[1] != b[1] for a, b in zip(rows, other)) > 5
    assert train(changed) == train(docs)


def test_language_model(docs, rows, empty):
    got = cmix.score_texts(docs).collect()
    assert len(got) == len(rows)
    cut = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    train = [r for r in rows if (0 if r[0] is None else crc(r[0], 7)) != 2]
    counts = Counter(w for r in train for w in cut(r[1]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r in rows:
        words = cut(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        g = by[r[0]][0]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9)
        assert g.score < 0 and math.isclose(g.bits_per_byte, -g.score * math.log2(10) / max(1, len((r[1] or "").encode())), rel_tol=1e-9) and g.held_out == (r[0] is not None and crc(r[0], 7) == 2)
    assert cmix.score_texts(empty).count() == 0


def test_rare_words_are_priced_by_their_counts(spark, docs, monkeypatch):
    """With few words in the tree the others take their share of the escapes from a join."""
    more = spark.createDataFrame([(5000, "river the of zzqx river"), (5000, "river the of zzqx river"), (None, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    whole = {r.doc_id: r for r in cmix.score_texts(both).collect()}
    monkeypatch.setattr(cmix, "HOT", 2.0**-6)
    few = cmix.score_texts(both).collect()
    assert len(few) == both.count()
    for r in few:
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known) and math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)
            assert r.score < 0
    twice = [r.score for r in few if r.doc_id == 5000]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_language_model_prefers_its_language(spark, docs):
    rng = random.Random(1)
    odd = "qzx jkwv xxqj zzvk wqpz"
    held = [i for i in range(1000, 1100) if crc(i, 7) == 2][:2]
    more = spark.createDataFrame([(held[0], sentence(rng, "en", 30)), (held[1], " ".join([odd] * 6))], "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in cmix.score_texts(docs.select("doc_id", "text").unionByName(more)).where("doc_id >= 1000").collect()}
    assert got[held[0]] > got[held[1]]


# 3. quality


def plain_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_counts(spark, docs, rows, empty):
    more = [(200, "a b c\na b c\nx\n\n  \nx"), (201, "##* é|ß <b> &amp; " * 20), (202, "a b c d " * 300)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = defaultdict(list)
    for r in weakq.judge(both).collect():
        got[r.doc_id].append(r)
    for i, text in [(r[0], r[1]) for r in rows] + more:
        want = plain_quality(text)
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert got[3][0].kept and not got[202][0].kept
    assert weakq.judge(empty).count() == 0


def plain_votes(text):
    """The rules on a text, one by one: 0 abstains, 1 good, 2 bad."""
    n, chars, symbols, dup, rep = plain_quality(text)
    words = re.split("[\x20\x09-\x0d]+", text or "")
    words = [w for w in words if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    kinds = {lower(w) for w in words}
    function = len({k.encode() for k in kinds} & weakq.FUNCTION_WORDS)
    ended = sum(x.rstrip(" \t\r\x0b\x0c").encode().endswith(weakq._ENDS) for x in lines)
    letters = sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in text or "")
    latin = sum(c.isascii() and c.isalpha() or 0xC0 <= ord(c) < 0x280 for c in text or "")
    upper = sum("A" <= c <= "Z" for c in text or "")
    wordlike = sum(not w.isascii() or w.strip(".,;:!?\"'()").isalpha() for w in words)
    a, b = max(n, 1), max(len(lines), 1)
    vote = lambda good, bad: 1 if good else 2 if bad else 0
    return [
        vote(n >= 100, n < 50), vote(function >= 3, n >= 10 and function == 0 and 2 * latin > letters), vote(ended / b >= 0.5, ended / b < 0.1), vote(False, chars / a < 2.2 or chars / a > 14), vote(False, symbols / a > 0.1),
        vote(False, dup / b > 0.3), vote(False, rep / a > 0.3), vote(False, upper > 0.5 * max(letters, 1)), vote(False, wordlike / a < 0.7), vote(False, n >= 10 and len(kinds) / a < 0.25),
    ]


def plain_posteriors(votes):
    """Expectation-maximisation text by text, with plain numbers."""
    rules, weight = len(votes[0]), weakq.PRIOR_TEXTS
    chance = [[list(weakq.PRIOR[k]) for _ in range(rules)] for k in (0, 1)]
    share, p = 0.8, []
    for _ in range(300):
        last, p = p, []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[0][r][x] / chance[1][r][x]) for r, x in enumerate(v))
            p.append(1 / (1 + math.exp(-odds)))
        for k in (0, 1):
            own = [q if k == 0 else 1 - q for q in p]
            chance[k] = [[(sum(q for q, v in zip(own, votes) if v[r] == x) + weight * weakq.PRIOR[k][x]) / (sum(own) + weight) for x in range(3)] for r in range(rules)]
        share = (sum(p) + 0.8 * weight) / (len(p) + weight)
        if last and max(abs(a - b) for a, b in zip(last, p)) < 1e-9:
            break
    return p


def test_verdicts_equal_brute_force(spark, docs, rows):
    rng = random.Random(31)
    more = [(300, "жук и лес " * 30), (301, "WORDS IN CAPITALS. " * 20), (302, "##* $$ %% " * 40), (303, "\n".join(["same line here"] * 40)), (304, " ".join(f"x{rng.randrange(99)}" for _ in range(90))), (305, "这 是 好 的。\n" * 20)]
    every = [(r[0], r[1]) for r in rows] + more
    got = defaultdict(list)
    for r in weakq.judge(docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))).collect():
        got[r.doc_id].append(r)
    for (i, text), p in zip(every, plain_posteriors([plain_votes(t) for _, t in every])):
        n, *_, rep = plain_quality(text)
        assert all(math.isclose(r.posterior, p, abs_tol=1e-6) and r.kept == (not (n < 50 or 100 * rep > 50 * n) and p >= weakq.KEEP) for r in got[i]), (i, p, [r.posterior for r in got[i]])


def test_em_separates_two_kinds_of_text():
    rng = np.random.default_rng(3)
    n = len(weakq.rules())
    y = rng.random(6000) < 0.85
    bad_votes = rng.random((6000, n)) < np.where(y[:, None], 0.01, 0.4)
    good_votes = (rng.random((6000, n)) < np.where(y[:, None], 0.8, 0.4)) & (np.arange(n) < 3)
    votes = np.where(bad_votes, 2, np.where(good_votes, 1, 0))
    patterns, where, counts = np.unique((votes * 3 ** np.arange(n)).sum(1), return_inverse=True, return_counts=True)
    p, chance = weakq.posteriors(patterns, counts.astype(float))
    assert ((p[where] > 0.5) == y).mean() > 0.97
    assert np.allclose(chance.sum(2), 1) and (chance[1, :, 2] > 0.3).all() and (chance[0, :, 2] < 0.05).all()
    assert len(weakq.posteriors(np.zeros(0, np.int64), np.zeros(0))[0]) == 0


# 4. licenses


def test_license_base(spark, docs, rows, empty):
    more = [(300, "CC BY cc-by, Cc By 4.0 x"), (301, "gnu general public license" * 2), (302, "the apache\nLicense! apache licenses MITlicense é cc by"), (303, None)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan(both).collect()}
    for i, text in [(r[0], r[1]) for r in rows if r[0] is not None] + more:
        words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        places, found = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            found |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(found)) and found <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("SPDX-License-Identifier: MPL-2.0", ["mpl-2.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("a cc by sa picture", ["cc-by-sa"]),
        ("nothing here", []),
    ],
)
def test_license_rules(text, labels):
    assert [d[0] for d in licenses.detect(licenses.normal(text.encode()).decode())] == labels


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()[0]) > 200


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining\n a copy of this software and associated files", "mit"),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY', "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
        ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived", "bsd-3-clause"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
        ("either expressed: IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM", "warranty-disclaimer"),
        ("Eclipse: This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "epl"),
    ],
)
def test_license_wording(text, label):
    assert label in licenses._row(text.encode())[5].split(",")


def example(rest, full=True):
    """Words that a clause's pattern for its rest takes: first alternatives, optional parts only if full."""
    rest = rest.removeprefix("?").replace("N", "some few words ").replace("V", "2 0")
    while m := re.search(r"\(\?:([^()]*)\)([?*]?)", rest):
        rest = rest[: m.start()] + ("" if m[2] and not full else m[1].split("|")[0]) + rest[m.end() :]
    rest = re.sub(r" \?", " ", rest).replace("v?", "v").replace("commercial", "commercial")
    return " ".join(rest.split())


CLAUSES = [tuple(x.strip() for x in line.split("|", 2)) for line in licenses.CLAUSES.strip().splitlines()]


def test_every_clause_finds_its_own_words():
    """Each with and without its optional parts; and no two clauses of a label say the same."""
    assert len(CLAUSES) > 220 and len(set(CLAUSES)) == len(CLAUSES)
    clauses = [r for r in licenses.rules()[0] if r[1] == "clause"]
    for (label, start, rest), rule in zip(CLAUSES, clauses, strict=True):
        for full in (True, False):
            words = f" x {start} {example(rest, full)} y ".replace("  ", " ")
            ends = [d[3] for d in licenses.matches(words, rule, 2)]
            assert ends and (not full or ends[0] == len(words) - 3), (label, words)
            assert any(d[0] == label or d[2] <= 3 for d in licenses.detect(words)), (label, words)


def test_rules_at_keywords_find_what_they_find_anywhere():
    """On texts of examples, names, tags and grants in any order, against trying every rule at every word."""
    rng = random.Random(8)
    names = [_ for line in licenses.LICENSES.strip().splitlines() for _ in line.split("|")]
    grants = ["licensed under the terms of the", "under the terms of the", "released under", "SPDX-License-Identifier:", "license", "or", "and", "x"]
    for _ in range(25):
        parts = [rng.choice((rng.choice(names), rng.choice(grants), " ".join((c := rng.choice(CLAUSES))[1:2]) + " " + example(c[2]), "w " * rng.randrange(60))) for _ in range(40)]
        words = licenses.normal(" ".join(parts).encode()).decode()
        every = {d for at, ch in enumerate(words) if ch == " " for r in licenses.rules()[0] for d in licenses.matches(words, r, at)}
        assert licenses.detect(words) == licenses.uncovered(every)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by", {"gpl"}),
        ("Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise", {"x11"}),
        ("Licensed under the EUPL.", {"eupl"}),
        ("Licensed under the EUPL, Version 1.2 or", {"eupl"}),
        ("Neither the name of the Regents of the University of California, Berkeley nor the names of its contributors may be used to endorse or promote products", {"bsd-3-clause"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR BSD-3-Clause AND MIT", {"gpl-2.0", "bsd-3-clause", "mit"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by"}),
        ("Use of this source code is governed by a BSD-style license", {"bsd"}),
    ],
)
def test_license_wording_of_old_gaps(text, labels):
    assert set(licenses._row(text.encode())[5].split(",")) >= labels


def plain_uncovered(found):
    order = sorted(found, key=lambda d: (-d[4], d[2] - d[3], d[2], d[0], d[1]))
    return sorted((d for i, d in enumerate(order) if not any(k[2] <= d[2] and d[3] <= k[3] for k in order[:i])), key=lambda d: (d[2], d[3], d[0], d[1]))


def test_suppression_equals_brute_force():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 20, 60):
        for _ in range(40):
            found = {(rng.choice("abc"), rng.choice("xy"), a := rng.randrange(30), a + rng.randrange(1, 15), rng.choice((50, 61, 90))) for _ in range(n)}
            assert licenses.uncovered(found) == plain_uncovered(found)


def test_long_license_texts_take_time_in_proportion():
    line = "Licensed under the Apache License, Version 2.0. MIT License; GNU General Public License, version 3 or later; CC BY-SA 4.0; permission is hereby granted free of charge to any person obtaining a copy of this software\n"
    begin = time.perf_counter()
    row = licenses._row((line * 5000).encode())
    assert time.perf_counter() - begin < 20 and row[1] == 20_000 and row[2] == 3 and row[3] == row[0] - 21 and len(row[7]) == 25_000


# 5. toxicity


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["scoundrel", "nitwit", "blockhead"]
    rows, labels = [], []
    for i in range(400):
        text = [sentence(rng, ("en", "de", "fr")[i % 3], 30) for _ in range(3)]
        toxic = i % 5 == 0
        if toxic:
            words = " ".join(text).split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            text = [" ".join(words)]
        rows.append((i, "\n".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, rows[0][1], "x"), (1002, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in toxzstd.classify(docs, table).collect():
        got[r.doc_id].append(r)
    held = [i for i in range(400) if crc(i, 4) == 2]
    assert all(got[i][0].held_out for i in held)
    assert sum(got[i][0].predicted == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for x in got.values() for r in x)
    assert len(got[1002]) == 2 and got[1000][0].predicted == 0
    kept = {r.doc_id for r in toxzstd.keep_clean(docs, table).collect()}
    assert kept == {i for i, x in got.items() if x[0].score < 0.3}


def test_savings_are_differences_of_lengths():
    rng = random.Random(9)
    rows = [(int(i % 4 == 0), " ".join([*sentence(rng, ("en", "de")[i % 2], 40).split(), *(["scoundrelly", "nitwits"] * 3 if i % 4 == 0 else [])])) for i in range(80)]
    model = toxzstd.fit(rows)
    how = zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=1, min_match=5, target_length=1, strategy=zs.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    length = lambda d, x: len(zs.ZstdCompressor(compression_params=how, dict_data=zs.ZstdCompressionDict(d + b" " * 16, dict_type=zs.DICT_TYPE_RAWCONTENT)).compress(x))
    for text in (rows[0][1], rows[1][1], "", "one", "A b C d E f G", rows[4][1] * 50):
        w = text.lower().encode().split()
        want = [length(model.ordinary, x) - length(model.ordinary + model.toxic, x) for x in (b" " + b" ".join(w[i : i + 6]) + b" " for i in range(0, len(w), 6))]
        assert toxzstd.savings(text.encode(), model.compressors()).tolist() == want
    assert b"scoundrelly" in model.toxic and b"house" not in model.toxic
    assert sum(toxzstd.savings(rows[0][1].encode(), model.compressors())) > 3 >= sum(toxzstd.savings(rows[1][1].encode(), model.compressors()))


def test_toxicity_of_ties_and_long_texts(spark):
    rng = random.Random(15)
    rows = [(i, sentence(rng, "en", 60) + (" vilewretch vilewretches" if i % 3 == 0 else "")) for i in range(120)]
    long = " ".join(sentence(rng, "en", 50) for _ in range(3000))
    more = [(900, long), (900, long), (901, ""), (902, None), (None, "x"), (903, rows[3][1])]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(900, 0), (900, 0), (901, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxzstd.classify(docs, labels).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.score)
    assert len(got) == len(rows) + len(more) and by[900][0] == by[900][1] and by[901] == by[902] and by[903] == by[3]
    assert {toxzstd.sample(docs, labels.where("doc_id = 900"), {0: 2}).select(F.octet_length("text").alias("n")).first().n <= toxzstd.SAMPLE_TEXT_BYTES} == {True}


def test_toxicity_without_labels(docs, labels, empty):
    assert toxzstd.classify(docs, labels.limit(0)).count() == docs.count()
    assert toxzstd.classify(empty, labels).count() == 0


# 6. pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p><b>First   part<br>goes on.<p>Second &lt;part&gt; with <a href=x>a link</a> inside it, and more words to read.</p><ul><li>item one<li>item two</ul>
<div class="comments"><p>Nice post, thank you very much indeed!</p></div></article><aside>Related</aside><form><input name=q>Search</form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert density.extract(PAGE) == "Head & line\nFirst part goes on.\nSecond <part> with a link inside it, and more words to read.\nitem one\nitem two"


def test_marks_of_class_and_id():
    page = '<body><div class="mainNav">menu</div><div id="pageFooter">foot</div><div class="site-header">top</div><article class="post"><div class="entry-header"><h1>Title</h1></div><p>Text of it.</p><div class="adBox ad">x</div><section id="commentList" class="user-comments"><p>me too</p></section></article></body>'
    assert density.extract(page) == "Title\nText of it."


IDS = "related-work search comments notice share skip-lists menu-driven alert-levels ad-1920 social-history overlay-networks login cookie-banner".split()


@pytest.mark.parametrize("name", IDS)
@pytest.mark.parametrize("around", ["article", "div", "main"])
def test_ids_made_of_headings_lose_nothing(name, around):
    text = lambda k: f"This is the paragraph {k} with quite a few words of running text in it."
    title = name.replace("-", " ").title()
    for part in (f'<h2 id="{name}">{title}</h2><p>{text(2)}</p>', f'<section id="{name}"><h2>{title}</h2><p>{text(2)}</p></section>', f'<div class="section" id="{name}"><h2>{title}</h2><p>{text(2)}</p></div>', f'<h2><a id="{name}">{title}</a></h2><p id="{name}-1">{text(2)}</p>'):
        page = f'<body><nav>a b</nav><{around}><h1>Top</h1><p>{text(1)}</p>{part}<p>{text(3)}</p></{around}><div class="ad">Buy {name} now</div></body>'
        assert density.extract(page).split("\n") == ["Top", text(1), title, text(2), text(3)]


@pytest.mark.parametrize(("attributes", "stays"), [('class="ad-hoc-networks"', True), ('class="notice-board"', True), ('class="social-history wide"', True), ('class="download"', True), ('class="ad"', False), ('class="x ad-slot-2"', False), ('class="topNav"', False), ('id="comments"', False), ('class="comments-area"', False), ('class="related posts-related"', False), ('id="cookie_consent"', False), ('class="ad-728x90"', False)])
def test_names_mark_as_a_whole(attributes, stays):
    page = f'<body><article><p>One paragraph with quite a few words of running text in it.</p><div {attributes}><p>Another paragraph with quite a few words of text.</p></div><p>A third paragraph with quite a few words.</p></article></body>'
    assert ("Another" in density.extract(page)) == stays


def test_a_marked_container_of_the_page_stays():
    body = "".join(f"<p>Paragraph {i} has quite a few words of running text in it.</p>" for i in range(4))
    assert density.extract(f'<body><div id="page-header-wrap" class="main-menu-wrapper">{body}</div><div class="ad">x</div></body>').count("\n") == 3


def test_main_text_without_article_element():
    body = "<body><div id=menu><a href=1>a</a></div><div><div>" + "".join(f"<p>Paragraph {i} has quite a few words of running text in it.</p>" for i in range(6)) + "</div></div><div><a href=1>x</a> <a href=2>y</a></div></body>"
    assert density.extract(body).split("\n") == [f"Paragraph {i} has quite a few words of running text in it." for i in range(6)]


def test_main_text_in_several_articles():
    part = lambda k: "".join(f"<p>Paragraph {k} {i} has quite a few words of running text in it.</p>" for i in range(4))
    want = [f"Paragraph {k} {i} has quite a few words of running text in it." for k in range(3) for i in range(4)]
    assert density.extract("<body><div>" + "".join(f"<article>{part(k)}</article>" for k in range(3)) + "</div></body>").split("\n") == want
    assert density.extract(f"<body><div><article>{part(0)}</article><section>{part(1)}</section><section>{part(2)}</section></div></body>").split("\n") == want
    assert density.extract(f"<body><form action=x><div>{part(0)}</div></form></body>").split("\n") == want[:4]
    assert density.extract("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold in all that follows.</p></article>") == "Let x=1 hold in all that follows."


def plain_chosen(root):
    """The same by the definitions alone, recursively, for trees without dropped nodes."""

    def own(n):
        return [x for x in n.items if isinstance(x, density.Node)]

    def below(n):
        return [y for x in own(n) for y in [x, *below(x)]]

    def chars(n):
        return sum(len(x.strip()) for m in [n, *below(n)] for x in m.items if isinstance(x, str))

    def links(n):
        return chars(n) if n.tag == "a" else sum(links(x) for x in own(n))

    def dense(n):
        c, t, lc, lt = chars(n), len(below(n)), links(n), sum(x.tag == "a" for x in below(n))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + links(root) / max(1, chars(root)) * c + math.e)
        return c / max(1, t) * math.log(max(math.e, c / max(1, lc) * max(1, t) / max(1, lt))) / max(1.0, math.log(max(math.e, base)))

    def block(n):
        return n.tag not in density.INLINE or any(map(block, own(n)))

    def total(n):
        return sum(dense(x) for x in own(n) if block(x)) + (dense(n) if any(isinstance(x, str) and x.strip() for x in n.items) else 0.0)

    nodes = [n for n in [root, *below(root)] if block(n) and chars(n)]
    if not nodes:
        return []
    top = next(n for n in nodes if total(n) == max(map(total, nodes)))
    path = []
    up = top
    while up:
        path.append(up)
        up = up.parent
    least = min(map(dense, path))

    def take(n):
        if n is top:
            return [n]
        if n in path:
            return [y for x in own(n) for y in take(x)]
        return [n] if chars(n) and links(n) * 2 < chars(n) and (dense(n) >= least or n.tag in density._HEADINGS) else []

    return take(root)


def test_choice_equals_the_definitions():
    rng = random.Random(12)

    def tree(depth):
        tag = rng.choice(["div", "div", "p", "section", "article", "main", "h2", "ul", "a", "b", "span"]) if depth else "div"
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else " ".join(["word"] * rng.randrange(1, 40)) + " " for _ in range(rng.randrange(4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(300):
        page = "<body>" + "".join(tree(3) for _ in range(rng.randrange(1, 4))) + "</body>"
        root = density.parse(page)
        want = plain_chosen(root)
        assert [id(n) for n in density.chosen(root)] == [id(n) for n in want], page


def test_article_tags_decide_nothing_that_density_does_not():
    part = "".join(f"<p>Paragraph {i} has quite a few words of running text in it.</p>" for i in range(4))
    for page in (PAGE, f"<body><div><article><h1>T</h1>{part}</article></div><div><a href=1>x</a> <a href=2>y</a></div></body>", f"<body><article><p><b>{part[3:60]}</b><br></article></body>"):
        assert density.extract(page) == density.extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", page))


@pytest.mark.parametrize(
    "page",
    ["<a '" * 60_000, "<b>" * 60_000, "<div>" * 30_000 + "</p></x>" * 20_000, "<script/>" * 30_000, "<center>" * 30_000, "<ul><li>" * 30_000, "<dd><li>" * 30_000, "<a '>x" * 40_000 + "'", "<" * 200_000, "<p>x" * 50_000, "<form><p>x</p>" * 20_000, "<!x" * 60_000, "<table><tr><td>" * 15_000],
)
def test_no_page_takes_more_than_its_length(page):
    begin = time.perf_counter()
    density.extract(page)
    assert time.perf_counter() - begin < 15


@pytest.mark.parametrize("page", ["", "plain", "<p", "<p>a", "</p></div>", "<script>x", "<!-- open", "<b>" * 3000 + "deep", "<a href='x>y", "&#0; &nosuch; &#x110000;", "<p>" * 20 + "x"])
def test_any_page_gives_a_text(page):
    assert isinstance(density.extract(page), str)


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<p>x y</p>", 5), (3, "v", "", 5)], "page_id long, url string, html string, text int")
    got = density.main_text(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[None] == "x y"
    assert density.main_text(df.limit(0)).count() == 0


# 7. packing


def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(pow2pack.TOKENIZER))
    more = [(400, "It's I'M x² ½ 10,000 <|endoftext|> Σας ΌΣΟΣ İx á naïve x\x1cy 日本語 …—"), (401, "can't WON'T they'll 3rd µm ªº ß×÷"), (402, "\x85 \x0b tab\there")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    pieces = defaultdict(list)
    got = pow2pack.pack(both).collect()
    for r in got:
        pieces[r.doc_id].append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    for i, text in [(r[0], r[1]) for r in rows] + more:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: (r.start, r.sequence_id))
        copies = sum(r[0] == i for r in rows) or 1
        ids = [x for r in own[::copies] for x in r.ids]
        assert ids == want
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    assert pow2pack.pack(empty).count() == 0
    with pytest.raises(ValueError):
        pow2pack.pack(docs, window=1000)


# 8. near duplicates


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_classes(fps):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    distinct = list(up)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    return {f: root(f) for f in distinct}


def test_near_duplicates(spark, docs, rows, empty):
    rng = random.Random(2)
    long = sentence(rng, "en", 400).split()
    near = [(500 + i, " ".join([*long[:i], "changed", *long[i + 1 :]])) for i in range(0, 60)]
    every = [(r[0], r[1]) for r in rows] + near
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = simhash.near_duplicates(both).collect()
    assert len(got) == len(every)
    fps = {i: plain_fingerprint(t) for i, t in every}
    roots = plain_classes(fps.values())
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == least[roots[fps[r.doc_id]]]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(both.withColumn("n", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


def test_keep_one_decides_by_row(spark):
    rng = random.Random(21)
    texts = [sentence(rng, "en", 60) for _ in range(12)]
    same = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + [(i, t) for i, t in enumerate(texts[8:], 100)]
    copies = [(None, texts[0]), (None, texts[9]), (3, texts[5]), (7, texts[8]), (7, texts[6]), (200, texts[11])]
    kept = simhash.keep_one(spark.createDataFrame(same + copies, "doc_id long, text string").repartition(3)).collect()
    assert len({plain_fingerprint(t) for t in texts}) == len(texts)
    want = [(None, texts[i]) for i in range(4)] + [(7, texts[4]), (3, texts[5]), (7, texts[6]), (7, texts[7]), (7, texts[8])] + [(i + 92, texts[i]) for i in range(9, 12)]
    order = lambda rows: sorted((str(i), t) for i, t in rows)
    assert order((r.doc_id, r.text) for r in kept) == order(want)
    ties = [(5, texts[0].upper()), (5, texts[0]), (5, texts[0]), (None, None), (None, ""), (None, " ")]
    assert order((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(ties, "doc_id long, text string")).collect()) == order([(5, min(texts[0], texts[0].upper())), (None, "")])


def test_links_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64) * 2 + rng.integers(0, 2, 150, dtype=np.uint64)
    fps = {int(s) for s in seeds} | {0}
    for s in seeds[:60]:
        for d in range(1, 7):
            x = int(s)
            for k in rng.choice(64, d, replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    crowd = int(seeds[-1])
    fps |= {crowd ^ 1 << a ^ 1 << b for a in range(20) for b in range(a, 20)}  # more than SMALL at one anchor
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    want = plain_classes(fps)
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    for many, tile in ((simhash.MANY, simhash.TILE), (simhash.MANY, 16), (1, simhash.TILE), (1, 40)):  # both layouts, with and without tiles
        monkeypatch.setattr(simhash, "MANY", many)
        monkeypatch.setattr(simhash, "TILE", tile)
        got = simhash.components(simhash.links(df)).collect()
        own = {r.node % 2**64: r.root % 2**64 for r in got}
        found = defaultdict(set)
        for f in fps:
            found[own.get(f, f)].add(f)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in found.values()}


def test_every_near_pair_shares_an_anchor():
    rng = np.random.default_rng(8)
    for bits, reach in ((21, 2), (22, 2), (32, 3)):
        x = rng.integers(0, 1 << bits, 300)
        y = x ^ (1 << rng.integers(0, bits, 300))
        if reach == 3:
            y ^= 1 << rng.integers(0, bits, 300)
        row, word = simhash.anchors(x, bits, reach)
        other, spoken = simhash.anchors(y, bits, reach)
        a, b = defaultdict(set), defaultdict(set)
        for r, w in zip(row, word):
            a[r].add(w)
            assert (int(w) ^ int(x[r])).bit_count() <= reach
        for r, w in zip(other, spoken):
            b[r].add(w)
        assert all(a[i] & b[i] for i in range(300))


def test_frequent_keys_are_looked_up_apart(spark):
    rows = spark.createDataFrame([(7, i) for i in range(900)] + [(None, 1), (8, 2)] + [(i, i) for i in range(100, 200)], "k long, x long")
    table = rows.where("k <> 8").groupBy("k").agg(F.max("x").alias("m"), F.count("*").alias("n"))
    got = simhash.looked_up(rows, table, "k", 1002).collect()
    assert sorted((r.k, r.x, r.m) for r in got) == [(7, i, 899) for i in range(900)] + [(i, i, i) for i in range(100, 200)]


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 700)] + [(10_000, i) for i in range(600, 650)] + [(5000, i) for i in range(5001, 5400)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in [*range(700), 10_000]} | {i: 5000 for i in range(5000, 5400)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# 9. decontamination


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))) for i, n in enumerate((5, 12, 30, 57, 120, 4, 1))] + [(50, None), (51, ""), (52, "w1 w1 w1 w1 w1 w1 w1")]
    items.append((60, items[2][1]))
    own = [(700 + i, f"{sentence(rng)} {t.upper() if i % 2 else t} {sentence(rng)}") for i, t in items if t]
    cut = lambda t, k: " ".join(t.split()[k:])
    own += [(800, f"{sentence(rng)} {cut(items[3][1], 8)} x"), (801, f"{sentence(rng)} {cut(items[3][1], 14)} x"), (802, items[5][1]), (803, None)]
    own.append((700, own[0][1]))
    both = docs.select("doc_id", "text", F.lit(1).alias("item_id")).unionByName(spark.createDataFrame([(*r, 1) for r in own], "doc_id long, text string, item_id int"))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for i, t in [(r[0], r[1]) for r in rows] + own:
        s = shingles(t)
        for k, x in items:
            q = shingles(x)
            if q and len(q & s) / len(q) >= 0.8 - 1e-12:
                want[i, k] = (len(q), len(q & s))
    for limit in (decontam.BROADCAST_ROWS, 0):
        old, decontam.BROADCAST_ROWS = decontam.BROADCAST_ROWS, limit
        got = decontam.contaminated(both, bench).collect()
        decontam.BROADCAST_ROWS = old
        assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want)
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(both, bench.limit(0)).count() == 0
    kept = decontam.keep_uncontaminated(both, bench)
    assert kept.columns == both.columns and kept.count() == both.count() - sum(1 for i, _ in [(r[0], 0) for r in rows] + own if any(k[0] == i for k in want))


def test_decontamination_drops_rows_not_ids(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    rows = [(None, "a b c d e f"), (None, "other words altogether"), (None, None), (4, "x a b c d e f"), (4, "clean words in here")]
    kept = decontam.keep_uncontaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("4", "clean words in here"), ("None", "None"), ("None", "other words altogether")]


def test_decontamination_is_native(docs, spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontam.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10. archives


def test_archives(spark):
    pages = [(1, "http://a", "<p>é x</p>", 0), (2, "http://b", "<p>é x</p>", 0), (3, None, None, 0), (4, "u", "", 0), (None, "n", "<p>é x</p>", 0), (5, "x\r\ny", "<p>\r\n\r\nWARC/1.1\r\n\r\n</p>" * 9000, 0), (2, "again", "<p>é x</p>", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int").repartition(2)
    got = warczst.round_trip(df).collect()
    assert len(got) == len(pages)
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(i if i is not None else -1, last.get(h or "", -1))
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == last[h or ""] else "revisit", str(None if i == last[h or ""] else last[h or ""])) for i, _, h, _ in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert warczst.round_trip(df.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warczst.read_archives(warczst.write_archives(df, min_revisit=10**6)).collect())


def test_archive_files(spark, tmp_path):
    records = [warczst.record(i, f"http://{i}", f"<p>page {i}</p>".encode() * 50) for i in range(200)]
    data = warczst.archive(records)
    (tmp_path / "x.warc.zst").write_bytes(data)
    assert list(warczst.frames(data)) == records
    assert warczst.read_archives(warczst.open_archives(spark, str(tmp_path))).count() == 200
    plain = b"".join(map(zs.ZstdCompressor().compress, records[:3]))
    assert list(warczst.frames(plain)) == records[:3]


def test_bad_archives():
    good = warczst.record(1, "u", b"abc")
    data = warczst.archive([good] * 20)
    for broken in (data[:-5], data[:20], data + b"xx"):
        with pytest.raises((warczst.BadArchive, zs.ZstdError)):
            list(warczst.frames(broken))
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type: response", b"WARC-Type: odd"), (b"WARC-Date", b"Date"), (b"abc", b"abd"), (b"\r\n\r\nHTTP", b"\r\nno colon\r\n\r\nHTTP")):
        with pytest.raises(warczst.BadArchive):
            warczst.parse(good.replace(old, new, 1))


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [" ".join(f"{rng.choice(WORDS['en'])}{rng.randrange(50)}" for _ in range(80)) for _ in range(60)]
    item = " ".join(f"q{rng.randrange(1000)}" for _ in range(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100, texts[5], "en", "s", 1), (101, f"{texts[6]} {item} {texts[7]}", "en", "s", 1), (102, None, None, None, None), (103, "", "en", "s", 0), (104, "12 34 !!", "en", "s", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(60))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with null and repeated ids, copies, empty and long texts and columns that clash with the operators' own; labels and a benchmark."""
    rng = random.Random(23)
    folder = tmp_path_factory.mktemp("corpus")
    item = " ".join(f"q{rng.randrange(1000)}" for _ in range(30))
    rows = [(i, sentence(rng, ("en", "de", "fr")[i % 3], 70) + (" vilewretch vilewretches" * 2 if i % 6 == 0 else ""), ("en", "de", "fr")[i % 3]) for i in range(150)]
    rows += [(200, rows[1][1], "en"), (7, rows[2][1], "de"), (7, sentence(rng, "fr", 50), "fr"), (None, rows[4][1], "en"), (None, sentence(rng, "en", 40), None), (None, rows[4][1], "en"), (201, f"{rows[7][1]} {item} {rows[8][1]}", "en"), (202, item.upper(), "en")]
    rows += [(203, None, "en"), (204, "", "en"), (205, " \n", None), (206, "12 34 !!", "en"), (207, " ".join(sentence(rng, "en", 60) for _ in range(400)), "en"), (208, "жук " * 40, None), (209, "Ok", "en")]
    df = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, item_id int, score int")
    df.repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(140)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), item


def test_every_stage_equals_brute_force(spark, corpus):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=repr)

    def toxic(df):
        model = toxzstd.train(df, labels)
        both = model.compressors()
        return [r for r in df.collect() if toxzstd.probability(model.weights, toxzstd.features(toxzstd.savings((r.text or "").encode(), both))) < 0.3]

    def spoken(df):
        trees = langid.train(df)
        bits = lambda t: langid.code_lengths(trees, *as_bytes([t.encode()]))[0].min()
        return [r for r in df.collect() if r.text and any(c.isalpha() for c in r.text) and bits(r.text) <= 7 * len(r.text.encode())]

    def single(df):
        own = df.collect()
        fps = [plain_fingerprint(r.text) for r in own]
        roots, best = plain_classes(fps), {}
        for r, f in zip(own, fps):
            rank = (r.doc_id is None, r.doc_id or 0, r.text)
            if roots[f] not in best or rank < best[roots[f]][0]:
                best[roots[f]] = rank, r
        return [r for _, r in best.values()]

    def clean(df):
        parts = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
        return [r for r in df.collect() if len(parts(item) & parts(r.text)) < 0.8 * len(parts(item))]

    for (name, stage), plain in zip(corpus_pipeline.STAGES, (toxic, spoken, single, clean)):
        want = sorted(((str(r.doc_id), r.text) for r in plain(docs)), key=repr)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and rows(out) == want and len(want) < docs.count(), name
        docs = out.cache()
    t = Tokenizer.from_file(public_tokenizers.path(pow2pack.TOKENIZER))
    want = []
    for r in docs.collect():
        n, at = len(t.encode(r.text, add_special_tokens=False).ids) + 1, 0
        for size in pow2pack.lengths(n):
            want.append((str(r.doc_id), at, size, n))
            at += size
    got = sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect())
    assert got == sorted(want)
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == got


def test_stages_of_empty_tables(spark, corpus):
    import corpus_pipeline

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
