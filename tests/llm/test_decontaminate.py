import random
import re
import tracemalloc

import pytest

from martlib.llm import decontaminate as D

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=13):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, u in items:
            v = words(u)
            k = min(n, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    ids |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), ",".join(sorted(ids)), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    rows = D.verdicts(df).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in rows), key=str)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c3", "É", "dd", "漢", f"w{rng.randrange(40)}"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 5, 12, 13, 14, 30, 60])))) for i in range(25)]
    items += [(100, None), (101, "- . -"), (None, " ".join(word() for _ in range(20))), items[3], (1000, items[4][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[8][1]), (3, items[8][1])]
    for i in range(4, 60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += [word() for _ in range(rng.randrange(40))]
            if rng.random() < 0.4:
                parts += (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "-"]).join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, items = cases(seed)
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(D.decontaminate(frame, bench)) == brute(docs, items)


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs, items = cases(4)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert got(D.decontaminate(frame, bench)) == brute(docs, items)


def test_words_hit_are_removed(spark):
    item = " ".join(f"i{k}" for k in range(15))
    docs = spark.createDataFrame([(1, f"Keep this. {item.upper()} And that"), (2, "All of it!"), (3, None)], "doc_id long, text string")
    rows = D.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), remove=True).collect()
    assert {r.doc_id: r.clean_text for r in rows} == {1: "keep this and that", 2: "All of it!", 3: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert got(D.decontaminate(docs, items.limit(0))) == [(1, 2, 0, "", False)]
    assert got(D.decontaminate(docs.limit(0), items)) == []


def test_a_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(13))
    docs = spark.createDataFrame([(1, "filler " * 300_000 + item)], "doc_id long, text string")
    assert got(D.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))) == [(1, 300_013, 13, "7", False)]


def test_arrays_of_a_block_are_bounded():
    """Bytes per window while the arrays are made and after, words of six bytes and of two."""
    rng = random.Random(5)
    for letters, count in [(5, 300_000), (1, 600_000)]:
        text = " ".join("".join(rng.choices("abcdefgh", k=letters)) for _ in range(count)).encode()
        size = len(text) // 10
        rows = [(str(i), text[i * size : (i + 1) * size]) for i in range(10)]
        tracemalloc.start()
        items = D.Items(rows, 13)
        kept, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert sum(len(w.hashes) for w in items.windows.values()) > 0.99 * count
        assert kept < 60 * count and peak < 60_000_000 + 100 * count, (kept / count, peak / count)


def test_a_window_of_many_items_counts_each(spark):
    shared = " ".join(f"s{k}" for k in range(13))
    items = [(i, f"own{i} {shared} {shared}") for i in range(500)] + [(900, shared)]
    docs = [(1, f"a {shared} b"), (2, shared.replace("s5", "x"))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.decontaminate(frame, bench)) == brute(docs, items)


def test_one_item_in_many_pieces(monkeypatch):
    monkeypatch.setattr(D.W, "BLOCK_WORDS", 7)
    text = " -".join(f"w{i % 19}" for i in range(100)).encode()
    words, at = D._squeezed(text)
    want = D.W.alnum_words(text)
    assert words.split() == want and D._hashes_of(words, at).tolist() == D.W.WordHashes().of(want).tolist()
    assert D._squeezed(b" .. ")[0] == b"" and len(D._squeezed(b"")[1]) == 1
