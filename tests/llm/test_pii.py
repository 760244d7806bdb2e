import random
import re

import pytest

from martlib.llm import pii as P

TEXTS = [
    "Write to Ann.Lee@Mail.example.org, ann.lee@mail.example.org or +1 (942) 555-3625.",
    "Call +1 (942) 555-3625 or 942-555-3625; card 4111 1111 1111 1111, again 4111-1111-1111-1111.",
    "Card 4699858775519183, SSN 123-45-6789, from 136.7.148.71. IBAN DE89370400440532013000 or DE89 3704 0044 0532 0130 00.",
    'token = "0401e44b4045d5b7fc925af2d5b1396433e9ee50" TOKEN = "0401E44B4045D5B7FC925AF2D5B1396433E9EE50"',
    "Mr. John Smith met Mrs Smith and Frau Müller, Herr Jörg Müller. Господин Иван Петров.",
    "Nothing here: 12 345 1.2.3 999.1.1.1 a@b version 1.2.3.4.5 2024-01-02",
    "ASK ME.37@MAIL9.EXAMPLE.COM!! 4699858775519183%%%",
    "",
    None,
]


def rows(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return {r.doc_id: r for r in P.replace_entities(docs, key).collect()}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_keep_format_and_identity(spark):
    got = rows(spark, TEXTS)
    assert [got[i].n_entities for i in range(9)] == [3, 4, 5, 2, 5, 0, 2, 0, 0]
    assert (got[5].text, got[7].text, got[8].text) == (TEXTS[5], "", None)
    mails = re.findall(r"\S+@\S+\w", got[0].text)
    assert len(mails) == 2 and mails[0] == mails[1] and "Lee" not in got[0].text
    phones = [re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[i].text)[0] for i in (0, 1)]
    assert phones[0] == phones[1] != "+1 (942) 555-3625"
    a, b = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{4}-\d{4}-\d{4}-\d{4})", got[1].text).groups()
    assert a == b.replace("-", " ") and a[0] == "4" and luhn(a.replace(" ", ""))
    card = re.search(r"Card (\d{16})", got[2].text)[1]
    assert luhn(card) == luhn("4699858775519183") and card + "%%%" in got[6].text
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}, from (\d+\.){3}\d+\. IBAN", got[2].text)
    one, two = re.search(r"IBAN (\S+) or (.+)\.", got[2].text).groups()
    assert one == two.replace(" ", "") and one[:2] == "DE" and len(one) == 22
    low, high = re.findall(r'"(\w+)"', got[3].text)
    assert low.upper() == high and re.fullmatch("[0-9a-f]{40}", low) and low not in TEXTS[3]
    assert re.search(r"U[0-9A-F]+@MAIL\.EXAMPLE!!", got[6].text)
    names = re.fullmatch(
        r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+), Herr (\w+) (\w+)\. Господин ([а-яА-Я]+) ([а-яА-Я]+)\.", got[4].text
    ).groups()
    assert names[1] == names[2] and names[3] == names[5] and names[1] != names[3]
    assert names[0].endswith("n") and not {"John", "Smith", "Müller", "Jörg"} & set(names)


def test_key_matters_and_runs_agree(spark):
    assert rows(spark, TEXTS)[2].text == rows(spark, TEXTS)[2].text != rows(spark, TEXTS, "other")[2].text


def test_collisions_are_drawn_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    # Three digits of room for 40 entities: many first draws collide, and some hit real values.
    monkeypatch.setattr(P, "_draw", lambda key: F.substring(F.translate(F.sha2(F.concat_ws("|", "form", "attempt"), 256), "abcdef", "012345"), 1, 2))
    entities = spark.createDataFrame([("card", f"{i:02d}") for i in range(40)], "kind string, form string")
    made = P.surrogates(entities, "k").collect()
    assert len(made) == 40 == len({r.surrogate for r in made})
    assert not {r.surrogate for r in made} & {r.form for r in made}


def test_many_documents_no_original_left(spark):
    rng = random.Random(5)
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(60)]
    mails = [f"person{i}@site{i % 7}.example.com" for i in range(60)]
    texts = [f"see {rng.choice(cards)} and {rng.choice(mails)}, " * rng.randrange(1, 6) for _ in range(120)] + [f"see {cards[0]} " * 3000]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        assert not any(x in got[i].text for x in cards + mails)
        assert len(got[i].text.split()) == len(t.split())
        # Equal words stay equal and different ones different.
        pairs = set(zip(t.split(), got[i].text.split()))
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[0])], "doc_id long, text string")
    got = P.replace_entities(docs, "k").collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1
    assert P.replace_entities(docs.limit(0), "k").collect() == []


def test_query_leaves_no_planted_entity(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in P.op3_pii_surrogates(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        hard = re.findall(r"(?<!\d)\d{16}(?!\d)|\b[0-9a-f]{40}\b|\+1 \(\d{3}\) 555-\d{4}|\w\S*@mail\d\.example\.com", d.text or "")
        assert not [x for x in hard if x in got[d.doc_id].text]
        if not hard and got[d.doc_id].n_entities == 0:
            assert got[d.doc_id].text == d.text


def test_very_long_entities(spark):
    """Hosts, names and texts of many parts: Java's matcher must not recurse by part."""
    n = 100_000
    texts = [
        "mail x@" + "ab." * n + "com now",
        "Mr Ab" + "-Ab" * n + " came",
        "Mr Ab" + "-Ab" * n + "X",
        "x@" + "a" * n + " y@" + "." * n + "com",
        "a@b." * 3000 + " " + "Frau " * n,
        "+1" + "1" * n + " 4111" + " 1111" * n + " " + "0a" * n,
    ]
    got = rows(spark, texts)
    assert got[0].n_entities == 1 and re.fullmatch(r"mail u[0-9a-f]{16}@mail\.example now", got[0].text)
    assert got[1].n_entities == 1 and len(got[1].text.split()) == 3 and "Ab" not in got[1].text
    assert got[2].n_entities >= 1 and got[5].n_entities >= 1


def test_mail_hosts(spark):
    texts = ["x@a.com...Then", "x@a.com-foo", "x@a.b.co1", "x@.com", "x@a..com", "x@a", "(x@a-b.example.org)"]
    got = rows(spark, texts)
    assert [got[i].n_entities for i in range(7)] == [1, 1, 1, 0, 0, 0, 1]
    assert [re.sub(r"u[0-9a-f]{16}@mail\.example", "M", got[i].text) for i in range(7)] == ["M...Then", "M-foo", "M1", *texts[3:6], "(M)"]


def test_columns_named_like_internal_ones(spark):
    names = ["_k1", "_k2", "_new", "_gaps", "_old", "_names", "_later", "__new", "N_ENTITIES", "at", "form", "kind", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(1, TEXTS[4], *names), (2, None, *names)], schema)
    got = P.replace_entities(docs, "k")
    assert got.columns == ["doc_id", *[n for n in names if n != "N_ENTITIES"], "text", "n_entities"]
    for r in got.collect():
        assert all(r[n] == n for n in names if n != "N_ENTITIES") and "Smith" not in str(r)
