import hashlib
import random
from collections import Counter

import pytest

from martlib.llm.substrings import op9_substring_dedup, remove_repeats


def brute(docs, window):
    words = [(d, (t or "").replace("\x85", "\x85").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def random_docs(seed, n=60, vocabulary=400):
    """Documents that share passages, with copies, near copies and loops."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(5, 90))] for _ in range(8)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.35:
            w = rng.choice(docs)[1].split() or ["x"]
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.42:
            text = " ".join([word(), word(), word()] * rng.randrange(1, 40))
        elif kind < 0.46:
            text = "one " * rng.randrange(1, 90)
        else:
            parts = []
            for _ in range(rng.randrange(1, 6)):
                parts += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 60))]
            text = " ".join(parts)
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("seed", range(5))
def test_against_brute_force(docs_of, seed):
    docs = random_docs(seed)
    assert rows(remove_repeats(docs_of(docs).repartition(4))) == brute(docs, 35)


@pytest.mark.parametrize("window, node", [(5, 3), (9, 3), (12, 4)])
def test_short_windows_with_few_words(docs_of, window, node):
    docs = random_docs(window, n=80, vocabulary=6)
    assert rows(remove_repeats(docs_of(docs), window, node)) == brute(docs, window)


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    docs = [
        (1, None), (2, ""), (3, " \n "), (4, "short text"), (4, "short text"), (5, long), (6, "x " + long),
        (None, " ".join(f"b{i}" for i in range(35))), (8, " ".join(f"b{i}" for i in range(35))), (9, "c " * 35), (10, "d " * 36),
    ]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, k1 long, n_words int")
    assert rows(remove_repeats(frame)) == brute(docs, 35)


def test_kept_text_and_spans(docs_of):
    shared = " ".join(f"s{i}" for i in range(40))
    got = {r.doc_id: r for r in remove_repeats(docs_of([f"p q {shared} r", f"{shared} t"])).collect()}
    assert (got[0].kept_text, got[0].removed) == ("p q r", [2, 42])
    assert (got[1].kept_text, got[1].removed) == ("t", [0, 40])


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([])).collect() == []


def test_query(spark):
    got = op9_substring_dedup(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows(got) == brute(map(tuple, docs), 35)
