import zlib

import numpy as np
import pytest

from martlib.llm.language import learn, mixture, op8_language_id, predict_languages, slots_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, stored):
    got = op8_language_id(spark, SF).collect()
    assert len(got) == stored.count()
    lang = {r.doc_id: r.lang for r in stored.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert 0.1 * len(got) < len(held) < 0.3 * len(got)
    right = sum(lang[r.doc_id] == r.lang_pred for r in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_are_found(spark, stored):
    model = learn(stored)
    texts = {lang: " ".join(r.text for r in stored.where(f"lang = '{lang}' AND n_chars BETWEEN 500 AND 3000").limit(4).collect()) for lang in ("de", "fr")}
    a, b = texts["de"], texts["fr"]
    n = min(len(a), len(b), 6000)
    who, share = mixture(model.likelihood, slots_of(a[: n // 4] + " " + b[: 3 * n // 4], model.bits))
    assert [model.languages[i] for i in who] == ["fr", "de"]
    assert abs(share[0] - 0.75) < 0.1
    who, share = mixture(model.likelihood, slots_of(a[:n], model.bits))
    assert [model.languages[i] for i in who] == ["de"] and share[0] == pytest.approx(1)


def test_counts_are_of_all_training_texts(spark):
    rows = [(i, f"text number {i} öäü ABC", "xx" if i % 2 else "yy", 5) for i in range(40)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, slot int").repartition(7))
    want = np.zeros((1 << 16, 2))
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            np.add.at(want[:, ["xx", "yy"].index(lang)], slots_of(text, 16), 1)
    want = (want + 0.5) / (want.sum(axis=0) + 0.5 * (1 << 16))
    assert np.allclose(model.likelihood, want, rtol=1e-5)


def test_edges(spark):
    rows = [
        (1, "der text ist gut", "de"), (2, "der text ist gut", "de"), (3, "le texte est bon", "fr"), (4, "le texte est bon", "fr"),
        (6, None, "de"), (7, "", None), (8, "123 $$$", "fr"), (None, "der", "de"), (9, "texte " * 50_000, None), (9, "x", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_languages(docs, learn(docs)).collect()
    assert len(got) == len(rows)
    said = {(r.doc_id, r.lang_pred) for r in got}
    assert {(6, "und"), (7, "und"), (8, "und"), (9, "fr")} <= said
    assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in predict_languages(docs, learn(docs)).collect()] == [("und", 0.0)]
    empty = docs.limit(0)
    assert predict_languages(empty, learn(empty)).collect() == []


def plain_mixture(columns, slots):
    """Mixture inference with lists: shares by expectation maximisation, languages left out one by one."""
    import math
    from collections import Counter

    from martlib.llm import language as L

    bag, total = sorted(Counter(slots.tolist()).items()), len(slots)

    def fit(langs, share):
        for _ in range(L._ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for slot, n in bag:
                each = {x: columns[x][slot] * share[x] for x in langs}
                whole = sum(each.values())
                for x in langs:
                    new[x] += n * each[x] / whole / total
            change = max(abs(new[x] - share[x]) for x in langs)
            share = new
            if change < L._CHANGE:
                break
        return share, sum(n * math.log(sum(columns[x][slot] * share[x] for x in langs)) for slot, n in bag)

    langs = list(columns)
    share, value = fit(langs, {x: 1 / len(langs) for x in langs})
    while len(langs) > 1:
        out = min(langs, key=lambda x: share[x])
        rest = [x for x in langs if x != out]
        scale = sum(share[x] + 1e-9 for x in rest)
        fewer, less = fit(rest, {x: (share[x] + 1e-9) / scale for x in rest})
        if less + L.PENALTY * math.log(total + 1) < value:
            break
        langs, share, value = rest, fewer, less
    return sorted(((share[x], x) for x in langs), key=lambda p: -p[0])


def test_predictions_equal_a_plain_version(stored):
    """Counts, mixture and selection again with plain loops, over whole documents."""
    docs = [r for r in stored.collect() if r.text is not None]
    learned = sorted({r.lang for r in docs if r.lang})
    counts = {x: [0.5] * (1 << 16) for x in learned}
    for r in docs:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5:
            for slot in slots_of(r.text, 16).tolist():
                counts[r.lang][slot] += 1
    columns = {}
    for x, c in counts.items():
        whole = sum(c)
        columns[x] = [n / whole for n in c]
    chosen = stored.where("doc_id % 9 = 0 AND n_chars < 4000")
    got = {r.doc_id: r for r in predict_languages(chosen, learn(stored)).collect()}
    seen = 0
    for r in docs:
        if r.doc_id in got and any(c.isalpha() for c in r.text):
            want = plain_mixture(columns, slots_of(r.text, 16))
            assert got[r.doc_id].languages == [x for _, x in want]
            assert got[r.doc_id].shares == pytest.approx([s for s, _ in want], abs=1e-3)
            seen += 1
    assert seen > 50


def test_signs_that_are_no_letters(spark):
    rows = [(i, t, "de") for i, t in enumerate(["wort und satz", "²", "½ ²", "Ⅷ", "１２", "_", "ª", "ж"])]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    said = {r.doc_id: r.lang_pred for r in predict_languages(docs, learn(docs)).collect()}
    assert [said[i] for i in range(8)] == ["de", "und", "und", "und", "und", "und", "de", "de"]


def test_too_many_language_tags(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        learn(docs)
