import re

from martlib.llm import pii as P

PHONES = ["+33 1 23 45 67 89", "+4915112345678", "942 555 3625", "1-800-555-1234", "+49 30 1234567", "+44 (0)20 7946 0958", "01 23 45 67 89"]


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_entities) for r in P.replace_entities(docs, "k").orderBy("doc_id").collect()]


def test_forms_of_phones_cards_and_secrets(spark):
    long = ["0a" * 40, "0a1b" * 50]
    got = replaced(spark, [f"call {p} now" for p in PHONES] + ["4699858775519183 12 items", "4699858775519183", *long])
    for phone, (text, n) in zip(PHONES, got):
        assert n == 1 and phone not in text
        assert re.sub(r"\d", "9", text) == re.sub(r"\d", "9", f"call {phone} now")
    (with_tail, n), (alone, _) = got[7], got[8]
    assert n == 1 and with_tail == alone + " 12 items" and alone != "4699858775519183"
    for secret, (text, n) in zip(long, got[9:]):
        assert n == 1 and len(text) == len(secret) and text != secret and re.fullmatch("[0-9a-f]+", text)


def test_names_and_their_later_mentions(spark):
    texts = [
        "Mr. McDonald met Mr O'Brien and Mrs Smith-Jones.",
        "Mr. John Smith came. Smith said that John's car, Smith-built, is blue. Smithy, smith.",
        "Smith without a title, and May.",
    ]
    (one, n1), (two, n2), (three, n3) = replaced(spark, texts)
    assert re.fullmatch(r"Mr\. \p{L}+ met Mr \p{L}+ and Mrs \p{L}+\.".replace(r"\p{L}", "[^\\W\\d_]"), one) and n1 == 3
    assert not re.search("McDonald|Brien|Smith|Jones", one)
    first, last, *again = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) said that (\w+)'s car, (\w+)-built, is blue\. Smithy, smith\.", two).groups()
    assert again == [last, first, last] and not {"John", "Smith"} & {first, last} and n2 == 4
    assert (three, n3) == (texts[2], 0)
