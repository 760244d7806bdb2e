import random

import numpy as np
import pytest

from martlib.llm import neardup
from martlib.llm.components import components
from martlib.llm.neardup import near_duplicates, sketch


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k):
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def random_docs(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = [[word() for _ in range(rng.randrange(20, 200))] for _ in range(6)]
    hot = [word() for _ in range(150)]
    for _ in range(n):
        kind = rng.random()
        base = list(hot if kind < 0.6 else rng.choice(docs))
        for _ in range(rng.randrange(0, 8)):
            base[rng.randrange(len(base))] = word()
        docs.append(base[rng.randrange(3) :] if kind < 0.3 else base)
    docs += [["short"], ["short"], ["Short", "two"], []]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 5), (3, 4)])
def test_against_brute_force(docs_of, seed, k):
    docs = random_docs(seed, 150)
    got = near_duplicates(docs_of(docs).repartition(3), k)
    assert sorted(map(tuple, got.collect())) == brute(docs, k)


def test_edges(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, None), (2, ""), (5, text), (3, text.upper()), (3, text.upper()), (None, text), (7, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, component_id string, n int")
    got = sorted(map(tuple, near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (5, 27, 3, False), (3, 27, 3, True), (3, 27, 3, True), (None, 27, None, True), (7, 1, 7, True)],
        key=str,
    )
    assert near_duplicates(docs.limit(0), 4).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    one = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    two = np.concatenate([one[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    a, b = sketch(one), sketch(two)
    j = 800 / 1200
    assert abs((a == b).mean() - j) < 4 * (j * (1 - j) / len(a)) ** 0.5
    single = sketch(one[:1])
    assert (single != np.iinfo(np.uint64).max).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 131)}}


def test_threshold_is_met_exactly(docs_of):
    # 9 shingles of which 8 are common to a set of 9: 8 / 10 is linked; 7 of 8 and 9 is not.
    base = [f"b{i}" for i in range(12)]
    docs = [(0, " ".join(base)), (1, " ".join(["z", *base[1:]])), (2, " ".join(["z", "y", *base[2:]]))]
    got = sorted(map(tuple, near_duplicates(docs_of(docs), 4).collect()))
    assert got == brute(docs, 4)
    assert neardup.THRESHOLD_PCT == 80
