import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from martlib.llm import winnowing as W


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def grams_of(text, gram):
    tokens = re.findall(f"[^\\x20\\x09-\\x0D]{{1,{W.TOKEN_CHARS}}}", text)
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
    if not h:
        return []
    if len(h) < gram:
        return [hash_longs(h)]

    def run(i, k):  # by the same doublings, one place at a time
        if k == 1:
            return h[i]
        power = 1 << (k.bit_length() - 1)
        if power == k:
            return hash_longs([run(i, k // 2), run(i + k // 2, k // 2)])
        at, size, value = power, power, run(i, power)
        while at < k:
            size = 1 << ((k - at).bit_length() - 1)
            value, at = hash_longs([value, run(i + at, size)]), at + size
        return value

    return [run(i, gram) for i in range(len(h) - gram + 1)]


def picks_of(text, gram=W.GRAM, window=W.WINDOW):
    h = [x >> 32 for x in grams_of(text, gram)]
    found = {}
    for i in range(max(1, len(h) - window + 1) if h else 0):
        at = min(range(i, min(i + window, len(h))), key=lambda j: (h[j], -j))
        found[at] = h[at]
    return sorted(found.items())


def shown(picks):
    return " ".join(f"{h & 0xFFFFFFFF:x}@{at}" for at, h in picks)


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def texts():
    r = random.Random(2)
    out = [words(r, n) for n in (0, 1, 4, 5, 6, 11, 12, 13, 60, 300)]
    out += ["", " \t\n", None, "x" * 100, "a " * 50, "zürich größe 東京 " * 9, "b" * 17 + " c", words(r, 500, 3)]
    return out


@pytest.mark.parametrize("gram, window", [(5, 8), (1, 1), (3, 6), (7, 5), (4, 16)])
def test_picks_equal_a_plain_loop(spark, docs_of, gram, window):
    made = W.with_picks(docs_of(texts()), "text", "picks", gram, window)
    got = {r.doc_id: list(zip(r.p, r.h)) for r in made.select(
        "doc_id", W.positions(F.col("picks")).alias("p"), F.transform("picks", lambda x: F.shiftright(x, 31).cast("int")).alias("h")
    ).collect()}
    for i, text in enumerate(texts()):
        assert got[i] == picks_of(text or "", gram, window), text


def test_shared_runs_share_a_pick(docs_of):
    r = random.Random(4)
    run = words(r, W.GRAM + W.WINDOW - 1, 10_000)
    docs = [words(r, r.randint(0, 30), 10_000) + " " + run + " " + words(r, r.randint(0, 30), 10_000) for _ in range(40)]
    sets = [set(r.hashes) for r in W.fingerprints(docs_of(docs)).collect()]
    assert all(a & b for a in sets for b in sets)


def by_hand(rows):
    def key(row):
        name = "-" if row[0] is None else str(row[0])
        return hashlib.sha256(f"{name}:{row[1] or ''}".encode()).digest()

    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, key(x)), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = picks_of(text), picks_of(edited), picks_of(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc, len(text), digest, shown(a), shown(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_a_plain_loop(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    rows += [(6, texts()[9]), (6, texts()[9]), (6, texts()[8]), (None, "no id"), (None, None), (None, words(random.Random(1), 90))]
    data = [(*r, "x", 1, "y") for r in rows]
    frame = spark.createDataFrame(data, "doc_id long, text string, key string, copies int, picks string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(W.op13_document_fingerprints(spark, str(tmp_path))) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the world")], [(1, None)], [(2, "same text"), (2, "same text"), (2, "same text")]])
def test_few_rows(spark, docs_of, rows):
    made = W.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(made) == (by_hand(rows) if rows else [])


def test_long_text(docs_of):
    long = words(random.Random(7), 60_000, 5000)
    row = W.fingerprints(docs_of([long])).first()
    assert row.fingerprint == shown(picks_of(long))


def test_texts_are_shuffled_once(spark, docs_of, tmp_path):
    rows = [(i, words(random.Random(i), 50)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = W.compare_with_edits(docs)
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan and "Python" not in plan
