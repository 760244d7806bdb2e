import random

import pytest
from pyspark.sql import functions as F

from martlib.llm import lines as L


def brute(docs, least):
    sites, first = {}, {}
    for d, t, s in docs:
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\f\r"):
                sites.setdefault(x, set()).update([s] if s is not None else [])
                if d is not None and (x not in first or first[x] is None or d < first[x]):
                    first[x] = d
                first.setdefault(x, None)
    boil = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for d, t, _ in docs:
        parts, seen, left, gone = (t or "").split("\n"), set(), [], 0
        for x in parts:
            own = x in boil and d == first[x] and x not in seen
            seen.add(x)
            if x in boil and not own:
                gone += 1
            else:
                left.append(x)
        words = sum(bool(x.strip(" \t\n\x0b\f\r")) for x in parts)
        out.append((d, words, gone, None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_removed", "clean_text").collect()), key=str)


@pytest.mark.parametrize("seed, least", [(1, 4), (2, 10), (3, 2)])
def test_against_brute_force(spark, seed, least):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(30)] + ["", " ", "\t"]
    docs = []
    for i in range(80):
        own = [f"own {i} {j}" for j in range(3)]
        text = "\n".join(rng.choice(pool if rng.random() < 0.7 else own) for _ in range(rng.randrange(1, 12)))
        docs.append((i, text, rng.choice([None, *(f"s{k}" for k in range(14))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    assert got(L.remove_boilerplate(frame, least)) == brute(docs, least)


def test_estimates_beyond_the_band_decide_alone_and_hold(spark):
    # 200 sites against a threshold of 100 is decided by the sketch, 97 and 103 by exact counts.
    docs = [(i, "\n".join(["wide"] * (i < 200) + ["under"] * (i < 97) + ["over"] * (i < 103) + [f"own{i}"]), f"s{i}") for i in range(220)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert got(L.remove_boilerplate(frame, 100)) == brute(docs, 100)


def test_edges(spark):
    docs = [
        (1, None, "a"), (2, "", "b"), (3, "x\nx\ny", "a"), (3, "x\nx\ny", "a"), (None, "x", "b"), (4, "x\n" * 5000, None), (5, "x", "c"),
    ]
    frame = spark.createDataFrame([(*d, "q", 3) for d in docs], "doc_id long, text string, source string, clean_text string, h1 int")
    assert got(L.remove_boilerplate(frame, 3)) == brute(docs, 3)
    assert L.remove_boilerplate(frame, 3).columns == ["doc_id", "text", "source", "h1", "n_lines", "n_removed", "clean_text"]
    assert L.remove_boilerplate(frame.limit(0), 3).collect() == []


def test_rows_of_one_line_lie_in_many_parts(spark):
    """A third of all lines is one line: its rows spread over the parts, in both joins by line."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 12) AS source", "concat('own ', id, '\nall of us\nmore ', id) AS text")
    parts = docs.select(*L._key(), F.lit(1).alias("pos")).groupBy(L._salt("_k1", "pos")).count().collect()
    assert len(parts) == L.SALTS and max(r["count"] for r in parts) < 3000 / L.SALTS * 2
    for sites, gone in [(10, 2999), (12, 2999), (13, 0)]:
        out = L.remove_boilerplate(docs, sites)
        assert out.agg(F.sum("n_removed")).first()[0] == gone
        assert out.where("n_removed = 0 AND clean_text = text").count() == 3000 - gone
