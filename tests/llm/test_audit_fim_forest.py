"""Filter interactions, fill-in-middle and the MinHash forest against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlake.llm import audit, common, fim, forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, mask int, row long, node long, part string"
VOCABULARY = [a + b for a in "ab cd ef gh ij kl mn op qr st uv wx yz".split() for b in ("a", "é", "I", "o", "ß", "ung", "able", "o'k")]


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 7, 7, 7, "x") for r in rows], SCHEMA).repartition(3)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        text = " ".join(rng.choice(VOCABULARY[: 8 + i]) for _ in range(rng.choice([3, 150, 199, 200, 260])))
        out.append((i, text + rng.choice(["", "", " #1", " A B C D E F G H I J"]), ("en", "de", None, "")[i % 4], "s"))
    out += [(100 + i, out[i % 7][1], out[i % 5][2], "s") for i in range(30)]
    out += [(200, None, "en", "s"), (201, "", "en", "s"), (202, " \n\t\x1c ", None, "s"), (3, out[3][1], out[3][2], "s"), (3, out[3][1], out[3][2], "s"), (None, out[4][1], "de", None), (None, None, None, None)]
    out += [(300, "x" * 200_000 + " y" * 90_000 + "<p>", "en", "s"), (301, "one <P> two", "en", "s"), (302, "word", "en", "s"), (303, "Word", "en", "s"), (304, "日本 語 é" * 30_000, "xx", "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@given(st.lists(st.text(alphabet="ab \n\t\x0b\x1cé日", max_size=30), max_size=8), st.integers(4, 40))
@settings(max_examples=200, deadline=None)
def test_word_hashes(texts, chunk):
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    before, common.CHUNK_BYTES = common.CHUNK_BYTES, chunk
    try:
        hashes, where = common.word_hashes(data, at)
    finally:
        common.CHUNK_BYTES = before
    assert np.diff(where).tolist() == [len(words(t)) for t in texts]
    every = [w for t in texts for w in words(t)]
    assert len(set(zip(every, hashes.tolist()))) == len(set(every)) == len(set(hashes.tolist()))


# filter interactions


def plain_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    out = defaultdict(Counter)
    for d, t, lang, _ in rows:
        w, t, part = words(t), t or "", lang or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in smallest and (d is None or d > smallest[t])}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["redundant"] += gone and fails[f]
                if fails[f] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += d in good
                    c["toxic_lost"] += d in toxic
                    out[part, f]["shapley"] += 1
                c["kept"] += not gone
    return {k: (*(c[x] for x in audit.COUNTS), out[k[0], k[1][k[2] - 1]]["shapley"]) for k, c in [*out.items()] if len(k) == 3}


def test_audit(spark, docs, rows):
    labels = [(i, int(i % 2), int(i % 5 == 0)) for i in range(0, 120, 3)] + [(6, 1, 0), (6, 0, None), (None, 1, 1), (9999, 1, 1), (7, None, None)]
    frame = spark.createDataFrame([(*x, "zz") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in audit.interactions(docs, frame).collect()}
    assert got == plain_audit(rows, labels) and len(got) == 4 * 600
    assert audit.interactions(docs, frame.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)
    assert audit.interactions(docs.limit(0), frame).count() == 0


# fill-in-middle


def plain_fim(doc_id, text, choice=fim.Choice()):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h1, h2, h3, h4 = fim.draws(doc_id, choice.seed)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= choice.percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < choice.suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fim_digests(docs, rows):
    got = Counter(tuple(r) for r in fim.digests(docs).collect())
    want = Counter((d, *(x := plain_fim(d, t))[:4], sha(x[4]), sha(t or "")) for d, t, *_ in rows)
    assert got == want and {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


def test_fim_outputs_and_pieces(docs, rows):
    choice = fim.Choice("7", 100, 50)
    got = Counter(tuple(r) for r in fim.outputs(docs, choice).collect())
    assert got == Counter((d, (x := plain_fim(d, t, choice))[1], x[4]) for d, t, *_ in rows)
    sizes = [len(r.piece) for r in fim.pieces(docs, choice).select("piece").collect()]
    assert max(sizes) <= 200_000 and sum(s > fim.PIECE_BYTES for s in sizes) <= 3  # only a unit that is longer itself


@given(st.text(alphabet="aZ<PSM>é日 \n\0", max_size=40), st.integers(0, 10_000))
@settings(max_examples=300, deadline=None)
def test_fim_cuts(text, doc_id):
    data = np.frombuffer(text.encode(), np.uint8)
    head, parts = fim.rearranged(data, doc_id, fim.Choice())
    want = plain_fim(doc_id, text)
    assert (*head, b"".join(parts).decode()) == want


# MinHash forest


def plain_classes(rows, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = words(lowered(t))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[root(k)].append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(sets[k]), least[root(k)], r[0] == least[root(k)]) for k, r in enumerate(rows))


def copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def similar(rows):
    rng = random.Random(11)
    long = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    texts = []
    for n, size, edits in ((60, 120, 14), (40, 60, 8), (5, 400, 30), (8, 12, 2), (12, 6, 1)):
        texts += copies(rng, long(size), n, edits)
    shared = long(50)
    texts += [f"{shared} {long(rng.randint(5, 40))}" for _ in range(60)]
    texts += [long(rng.randint(1, 80)) for _ in range(60)]
    rng.shuffle(texts)
    return [r for r in rows if r[0] not in (300, 304)] + [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]


def test_forest(spark, similar):
    got = Counter(tuple(r) for r in forest.near_duplicates(table(spark, similar)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == plain_classes(similar)


def test_forest_in_crowded_regions(spark, similar, monkeypatch):
    """Regions are divided, and dealt out in tiles, without a change of the result."""
    monkeypatch.setattr(forest, "REGION", 4)
    monkeypatch.setattr(forest, "VOLUME", 900)
    got = Counter(tuple(r) for r in forest.near_duplicates(table(spark, similar)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == plain_classes(similar)


def test_forest_edges(spark, docs):
    assert forest.near_duplicates(docs.limit(0)).count() == 0
    alone = table(spark, [(5, None, "en", "s"), (6, "", "en", "s"), (7, " ", "en", "s"), (8, "a b", "en", "s"), (8, "a b", "en", "s"), (None, "a B", "en", "s"), (None, "q", "en", "s")])
    got = sorted((tuple(r) for r in forest.near_duplicates(alone).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (8, 1, 8, True), (None, 1, 8, False), (None, 1, None, True)], key=str)


def test_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    for shared, own in ((400, 50), (8, 1), (2000, 250)):
        hits = []
        for _ in range(60):
            a = rng.integers(1, 1 << 63, shared + 2 * own, dtype=np.uint64)
            hits.append((forest.minima(np.sort(a[: shared + own])) == forest.minima(np.sort(np.delete(a, slice(shared, shared + own))))).mean())
        assert abs(np.mean(hits) - shared / (shared + 2 * own)) < 0.03
