import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from martlib.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, n_words string, extra int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), len(lines) - len(set(lines)), len(covered), failed,
    )


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta,", "g#m", "d|", "é漢", "x"]
    made = [None, "", " ", "\n\n", "a", "one two\none two\n one two\n\t\n", "x " * 5000, "\x85 \xa0 y z"]
    for _ in range(60):
        run = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        t = []
        for _ in range(rng.randrange(1, 12)):
            t += run if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(1, 30))]
            t.append(rng.choice(["\n", "\t", " ", "\x0b"]))
        made.append(" ".join(t))
    return made


def test_counts_against_brute_force(spark):
    rows = [(i, t, "en", "clash", 7) for i, t in enumerate(texts())]
    got = Q.with_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.extra == 7 for r in got)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text


@pytest.mark.parametrize("n, k", [(100, 0), (1000, 3), (1000, 9), (5000, 20), (37, 0), (20, 5)])
def test_binomial_tail_is_exact(spark, n, k):
    p = 0.01
    want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k <= n * p else 1.0
    got = spark.range(1).select(Q.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_binomial_tail_is_never_too_small_when_cut(spark, monkeypatch):
    monkeypatch.setattr(Q, "_TERMS", 3)
    want = sum(comb(1000, j) * 0.05**j * 0.95 ** (1000 - j) for j in range(31))
    got = spark.range(1).select(Q.binomial_tail(F.lit(1000), F.lit(30), 0.05)).first()[0]
    assert want <= got < 3 * want


def labelled(spark, n_good, n_bad, above):
    """Good documents, some of them above the strictest cutoff, and symbol-ridden ones."""
    word = lambda i, j: f"w{i}x{j}"
    rows = []
    for i in range(n_good + n_bad):
        bad = i >= n_good or i < above
        rows.append((i, " ".join(word(i, j) + ("##" if bad else "") for j in range(25)), "en", "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < n_good)) for i in range(n_good + n_bad)], "doc_id long, quality int")
    return docs, labels


def kept(docs, labels):
    return {r.doc_id: r.kept for r in Q.verdicts_of(Q.with_counts(docs), labels).collect()}


def test_proven_cutoffs_reject_and_unproven_do_not(spark):
    docs, labels = labelled(spark, 700, 5, above=0)
    said = kept(docs, labels)
    assert all(said[i] for i in range(700)) and not any(said[i] for i in range(700, 705))
    # Too few labels to prove anything, and too many good documents above the cutoff.
    assert all(kept(*labelled(spark, 50, 5, above=0)).values())
    assert all(kept(*labelled(spark, 700, 5, above=40)).values())


def test_three_hundred_labels_prove_a_cutoff_and_the_rest_is_shown(spark):
    docs, labels = labelled(spark, 300, 5, above=3)
    rare = spark.createDataFrame([(i, f"mot{i} " * 30, None, "", 0) for i in range(1000, 1040)], SCHEMA)
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i in range(1000, 1040)], "doc_id long, quality int"))
    counted = Q.with_counts(docs.unionByName(rare.where("doc_id > 0")))
    found = {r.stratum: r for r in Q.risk_controlled_cutoffs(counted, labels).collect()}
    assert found["en"].n == 300 and found["en"].step == Q.STEPS - 1 and found["en"].cut_symbols == 100
    assert "" not in found or found[""].step is None
    said = {r.doc_id: r.kept for r in Q.verdicts_of(counted, labels).collect()}
    assert sum(not said[i] for i in range(300)) == 3 and not any(said[i] for i in range(300, 305))


def test_columns_named_like_internal_ones(spark):
    names = ["_h", "_w", "__s", "_stratum", "a.b", "kept", "quality_step", "n_lines"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(1, "word " * 30, "en", *names)], schema)
    made = Q.verdicts_of(Q.with_counts(docs), spark.createDataFrame([], "doc_id long, quality int"))
    row = made.first()
    assert [row[n] for n in names[:5]] == names[:5] and "quality_step" not in made.columns
    assert row.kept is False and row.n_lines == 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "", 0), (None, "word " * 3, "en", "", 0), (2, "a b", "en", "", 0), (2, "a b", "en", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = Q.verdicts_of(Q.with_counts(docs), labels).collect()
    assert len(got) == 4 and not any(r.kept for r in got)
    assert Q.verdicts_of(Q.with_counts(docs.limit(0)), labels.limit(0)).collect() == []
