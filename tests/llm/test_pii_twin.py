"""The whole result of surrogate generation against plain Python; only the patterns are shared."""

import hashlib

import regex

from martlib.llm import pii as P
from .test_pii import TEXTS


def ported(pattern):
    """A pattern of Java's in the dialect of ``regex``: ASCII digits, names of groups."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith(r"\d", i):
            out.append("0-9" if inside else "[0-9]")
            i += 2
        elif pattern.startswith(r"\k<", i):
            end = pattern.index(">", i)
            out.append(f"(?P={pattern[i + 3 : end]})")
            i = end + 1
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


ANY = regex.compile(ported(P.ANY))
LONE = regex.compile(ported(P._LONE))
KINDS = [(kind, regex.compile(ported(p))) for kind, p in P.KINDS]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def draw(key, kind, form, attempt):
    digest = "".join(sha(f"{key}|{kind}|{form}|{attempt}|{block}") for block in "01")
    number = digest.translate(str.maketrans("abcdef", "012345"))
    size = len(form)
    if kind == "email":
        return f"u{digest[:16]}@mail.example"
    if kind == "secret":
        while len(digest) < size:
            digest = "".join(sha(f"{digest}|{i + 1}") for i in range(-(-size // 64)))
        return digest[:size]
    if kind == "ip":
        return ".".join(str(int(digest[4 * i : 4 * i + 4], 16) % 254 + 1) for i in range(4))
    if kind == "iban":
        letters = digest.translate(str.maketrans("0123456789", "GHIJKLMNOP"))
        return form[:2] + number[:2] + letters[2 : size - 2].upper()
    if kind == "card":
        body = form[0] + number[: size - 2]
        check = -luhn(body + "0") % 10
        return body + str(check if luhn(form) % 10 == 0 else (check + 1 + int(number[59]) % 9) % 10)
    if kind.startswith("name"):
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", form) else "latin"
        some = [P._SYLLABLES[script][int(c, 16)] for c in digest[: min(30, 4 + attempt // 4)]]
        return "".join(some) + P._ENDINGS[script, kind[-1]]
    return form[0] + number[: size - 1]


def distinct_surrogates(entities, key):
    attempts = dict.fromkeys(entities, 0)
    while True:
        drawn = {(kind, form): draw(key, kind, form, n) for (kind, form), n in attempts.items()}
        first = {}
        for kind, form in sorted(drawn):
            first.setdefault((kind, drawn[kind, form]), form)
        lost = [e for e, new in drawn.items() if (e[0], new) in entities or first[e[0], new] != e[1]]
        if not lost:
            return drawn
        for e in lost:
            attempts[e] += 1


def entities_of(mention):
    """(kind, form, as written) of a mention, one for each word of a name."""
    kind = next(k for k, p in KINDS if p.fullmatch(mention))
    if kind == "name":
        title, *words = mention.split(" ")
        given = "name-f" if title.rstrip(".") in P.FEMALE else "name-m"
        return [(given, w.lower(), w) for w in words[:-1]] + [("name-s", words[-1].lower(), words[-1])]
    if kind in ("email", "secret", "ip"):
        return [(kind, mention.lower(), mention)]
    return [(kind, mention.replace(" ", "") if kind == "iban" else regex.sub("[^0-9]", "", mention), mention)]


def written(kind, mention, made):
    if kind in ("email", "secret"):
        return made.upper() if mention == mention.upper() != mention.lower() else made
    if kind == "ip":
        return made
    if kind == "iban":
        return " ".join(made[i : i + 4] for i in range(0, len(made), 4)) if " " in mention else made
    if kind.startswith("name"):
        return made.capitalize()
    digits = iter(made)
    return regex.sub("[0-9]", lambda _: next(digits), mention)


def brute(texts, key):
    found = [[(m.span(), m[0], entities_of(m[0])) for m in ANY.finditer(t or "")] for t in texts]
    table = distinct_surrogates({(k, f) for ms in found for *_, es in ms for k, f, _ in es}, key)
    out = []
    for text, ms in zip(texts, found):
        if text is None:
            out.append((None, 0))
            continue
        names = {}
        for *_, es in ms:
            for kind, form, mention in es:
                if kind.startswith("name"):
                    names.setdefault(form, written(kind, mention, table[kind, form]))
        n = len(ms)

        def later(m):
            nonlocal n
            n += m[0].lower() in names
            return names.get(m[0].lower(), m[0])

        made, at = [], 0
        for (start, stop), mention, es in ms:
            made.append(LONE.sub(later, text[at:start]))
            title = mention[: mention.index(" ") + 1] if es[0][0].startswith("name") else ""
            made.append(title + " ".join(written(k, m, table[k, f]) for k, f, m in es))
            at = stop
        made.append(LONE.sub(later, text[at:]))
        out.append(("".join(made), n))
    return out


def check(spark, texts, key):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in P.replace_entities(docs, key).collect()}
    want = brute(texts, key)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


def test_hand_written_texts(spark):
    more = [
        "Mr James Brown met Mr James. Later James and O'Brien. Mr O'Brien-Smith, Mrs McDonald: McDonald's.",
        "+33 1 23 45 67 89, +4915112345678, 1-800-555-1234, 4699858775519183 12, 3782 822463 10005, AMEX 378282246310005",
        "0a" * 90 + " " + "0A" * 70 + " " + "0a" * 32,
        "Frau Müller. Frau Müller\nHerr Weiß und Господин Петров: Петров, петров.",
    ]
    check(spark, TEXTS + more, "k")


def test_names_whose_first_draws_collide(spark):
    names = [f"Aa{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(676)]
    assert len({draw("c", "name-s", x.lower(), 0) for x in names}) < len(names)
    check(spark, [f"Mr {x} and 10.0.{i % 256}.1" for i, x in enumerate(names)], "c")


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [d.text for d in docs], P.QUERY_KEY)
