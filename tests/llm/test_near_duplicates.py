"""Near-duplicates against all pairs, and the corner cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rillstone.llm import minhash, textbytes
from rillstone.llm.components import connected
from rillstone.llm.scratch import Scratch

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    """Copies, groups of near copies that differ among each other, a passage that many share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 80))) for _ in range(60)]
    base = [word() for _ in range(90)]
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(2, 30))) for _ in range(40)]
    texts += texts[:10] * 3 + ["", None, "one", "One", "a b c", "a  B\tc", "é É", "x " * 5000]
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [4, 5])
def test_matches_all_pairs(spark, size):
    rows = corpus()
    expected = brute(rows, size, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "'z' as k", "1 as comp")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=size).collect()}
    assert got == expected


def test_kept_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(300_000)]
    near, far = list(words), list(words)
    near[1000:200_000:100] = ["n"] * 1990
    far[::20] = ["f"] * 15_000
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4).collect()}
    assert got == brute(rows, 4, 80)
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 1]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = rng.integers(0, 2**63, 800), rng.integers(0, 2**63, 100), rng.integers(0, 2**63, 100)
    x, y = (np.concatenate((common, z)).astype(np.uint64) for z in (a, b))
    s = minhash.sketch(np.concatenate((x, y)), np.array([0, 900, 1800]), 336)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.09
    tiny = minhash.sketch(np.array([7], np.uint64), np.array([0, 1]), 48)
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_words_and_shingles_by_bytes():
    texts = ["Ab cd\tEF", "", "é x", "one"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    w = textbytes.words(np.frombuffer(b"".join(raw), np.uint8), offs, textbytes.NOT_SPACE)
    assert w.doc.tolist() == [0, 0, 0, 2, 2, 3]
    again = textbytes.words(np.frombuffer(b"AB zz ef", np.uint8), np.array([0, 8]), textbytes.NOT_SPACE)
    assert again.hash[0] == w.hash[0] and again.hash[2] == w.hash[2] and again.hash[1] != w.hash[1]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 330)]
    root = defaultdict(int)
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    loops = {a for a, b in links if a == b}
    assert {k: v for k, v in got.items()} == {k: find(k) for k in root if k in got} and set(root) - set(got) <= loops
