"""Surrogates for personal data: keyed, consistent with the original's type, and distinct.

Detected are e-mail addresses, IPv4 addresses, phone numbers, card numbers, social security
numbers, bank account numbers, secrets (long hexadecimal strings) and names after a title. Each
entity has a canonical form (digits only, lower case, one word of a name), so all its mentions get
one surrogate however they are written, and each mention keeps its own format: digits go
where digits were, with the first one kept (country, card network), separators stay, card
numbers keep their Luhn check true or false, hexadecimal strings keep length and case, names
keep gender (from the title) and script and the number of words; two people with one family
name still share one. A word of a titled name is replaced, and counted, wherever else it stands
capitalised in the same text, also where it is an ordinary word ("Mr May ... in May").

Surrogates derive from ``key`` by SHA-256. A surrogate that another entity of its kind already
has, or that is itself a detected entity, is drawn again with the next attempt number until all
are distinct; each round looks at all entities, and nothing but a count reaches the driver.

Only DataFrame functions. Distinct entities are what is hashed and compared, so an entity that
a third of all rows mention costs one row there.

Defined cases: null text stays null; texts without entities stay as they are; repeated rows
give repeated results; extra columns of any name are kept, only ``n_entities`` is replaced; empty
tables give empty results; entities may be of any length. When ``MAX_ATTEMPTS`` draws leave a collision (an
entity kind with nearly as many values as its format has surrogates) an error is raised. A word that is a
family name in one mention and a given name in another has a surrogate for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlib.storage import write_through

MAX_ATTEMPTS = 64

# Titles with the gender they tell; Latin and Cyrillic.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа")

# Runs of unbounded length are single character classes or possessive groups: Java's matcher goes
# into recursion for every round of any other repeated group, and long entities overflow its stack.
_EMAIL = (
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@"
    r"[\p{L}\p{N}\-][\p{L}\p{N}.\-]*(?<!\.)\.\p{L}{2,}"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_PHONE = "|".join((
    r"(?<![\p{L}\d])\+\d{8,15}(?!\d)",
    r"(?<![\p{L}\d])\+\d{1,3}[ .\-]?\(0\)[ .\-]?\d{1,4}(?:[ .\-]\d{2,8}){1,4}(?!\d)",
    r"(?<![\p{L}\d])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
    r"(?<![\p{L}\d])\+(?=(?:[ .\-]?\d){8})\d{1,3}(?<ps>[ .\-])\d{1,4}(?:\k<ps>\d{2,8}){1,4}(?!\d)",
    r"(?<![\p{L}\d])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)",
    r"(?<![\p{L}\d])\+\d{1,3}[ .\-]?\d{1,5}[/\-]\d{5,10}(?!\d)",
    r"(?<![\p{L}\d\-])1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])",
    r"(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    r"(?<![\p{L}\d\-])\d{3} \d{3}[ \-]\d{4}(?![\p{L}\d\-])",
    r"(?<![\p{L}\d\-.])0\d(?<pn>[ .\-])\d{2}(?:\k<pn>\d{2}){3}(?![\d\-])",
    r"(?<![\p{L}\d\-.])0\d{2,4}[ /\-]\d{6,8}(?![\d\-])",
))
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
# Digits beyond the sixteenth belong to a card only in the card's own style of separators.
_CARD = "|".join(
    rf"(?<![\p{{L}}\d]){p}(?![\p{{L}}\d])"
    for p in (
        r"\d{16,19}",
        r"\d{4}(?<cs>[ \-])\d{4}\k<cs>\d{4}\k<cs>\d{4}(?:\k<cs>\d{1,3})?",
        r"\d{4}(?:[ \-]?\d{4}){3}",
        r"3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}",
    )
)
_IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\p{L}\d])"
_SECRET = r"(?<![\p{L}\d])(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\d])"
# A word of a name: inner capitals, and parts joined by hyphens or apostrophes.
_PART = r"\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*+"
_WORD = rf"(?:\p{{Lu}}\p{{Ll}}*['’])?{_PART}(?:['’\-]{_PART}(?!\p{{L}}))*+"
_NAME = rf"(?<!\p{{L}})(?:{'|'.join((*FEMALE, *MALE))})\.? {_WORD}(?: {_WORD}){{0,2}}(?!\p{{L}})"
# Any word that could be a name without title.
_LONE = rf"(?<!\p{{L}}){_WORD}(?!\p{{L}})"

# Kind and pattern, in the order in which they are tried at a place.
KINDS = (
    ("email", _EMAIL),
    ("secret", _SECRET),
    ("iban", _IBAN),
    ("ip", _IP),
    ("card", _CARD),
    ("ssn", _SSN),
    ("phone", _PHONE),
    ("name", _NAME),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)

# Syllables of invented names; a hash picks them, so there is no end of names.
_SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "sa", "ti", "va", "we", "zo", "lu"),
    "cyrillic": ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "са", "ти", "ва", "ве", "зо", "лу"),
}
_ENDINGS = {
    ("latin", "m"): "n", ("latin", "f"): "na", ("latin", "s"): "rd",
    ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "s"): "рд",
}


def _key() -> list:
    return [
        F.xxhash64("text").alias("_k1"),
        F.xxhash64(F.lit(7), F.col("text")).alias("_k2"),
    ]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    signs = F.reverse(F.split(digits, ""))
    return F.aggregate(
        F.transform(
            signs,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.lit(2) * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, at, part, kind, form, mention) of each entity in each distinct text.

    ``part`` numbers the words of a name, each an entity of kind name-m, name-f or name-s
    (family name: the last of several words, or the only one).
    """
    found = docs.select(*_key(), F.regexp_extract_all("text", F.lit(ANY), 0).alias("m")).where(F.size("m") > 0)
    found = write_through(found, "pii-mentions").distinct()
    kind = reduce(
        lambda a, k: a.when(F.col("mention").rlike(f"^(?:{k[1]})$"), k[0]),
        KINDS[1:],
        F.when(F.col("mention").rlike(f"^(?:{KINDS[0][1]})$"), KINDS[0][0]),
    )
    rows = found.select("_k1", "_k2", F.posexplode("m").alias("at", "mention")).withColumn("kind", kind)
    words = F.split(F.col("mention"), " ")
    title = F.regexp_extract("mention", r"^\p{L}+", 0)
    gender = F.when(title.isin(*FEMALE), "name-f").otherwise("name-m")
    names = (
        rows.where("kind = 'name'")
        .select("_k1", "_k2", "at", F.posexplode(words).alias("part", "word"), F.size(words).alias("n"), gender.alias("g"))
        .where("part > 0")
        .select(
            "_k1", "_k2", "at", "part", F.when(F.col("part") == F.col("n") - 1, "name-s").otherwise(F.col("g")).alias("kind"),
            F.lower("word").alias("form"), F.col("word").alias("mention"),
        )
    )
    form = (
        F.when(F.col("kind").isin("email", "secret", "ip"), F.lower("mention"))
        .when(F.col("kind") == "iban", F.regexp_replace("mention", " ", ""))
        .otherwise(_digits(F.col("mention")))
    )
    rest = rows.where("kind <> 'name'").select("_k1", "_k2", "at", F.lit(0).alias("part"), "kind", form.alias("form"), "mention")
    return rest.unionByName(names)


def _draw(key: str) -> Column:
    """The surrogate's canonical form for columns kind, form and attempt."""
    block = lambda n: F.sha2(F.concat_ws("|", F.lit(key), "kind", "form", "attempt", F.lit(str(n))), 256)
    digest = F.concat(block(0), block(1))
    number = F.translate(digest, "abcdef", "012345")
    size = F.length("form")
    kept = F.left("form", F.lit(1))
    plain = F.concat(kept, F.substring(number, F.lit(1), size - 1))
    body = F.concat(kept, F.substring(number, F.lit(1), size - 2))
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    valid = _luhn_sum(F.col("form")) % 10 == 0
    last = F.when(valid, check).otherwise((check + 1 + F.substring(number, 60, 1).cast("int") % 9) % 10)
    card = F.concat(body, last.cast("string"))
    # Two blocks last for 128 digits; longer secrets take further ones made of these two.
    blocks = F.transform(F.sequence(F.lit(1), F.ceil(size / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", digest, i.cast("string")), 256))
    long = F.substring(F.array_join(blocks, ""), F.lit(1), size)
    hexes = F.when(size > F.length(digest), long).otherwise(F.substring(digest, F.lit(1), size))
    octet = lambda i: (F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long") % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    email = F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@mail.example"))
    letters = F.translate(digest, "0123456789", "GHIJKLMNOP")
    iban = F.concat(F.left("form", F.lit(2)), F.substring(number, 1, 2), F.upper(F.substring(letters, F.lit(3), size - 4)))
    script = F.when(F.col("form").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def name(script_: str, kind: str) -> Column:
        # Four syllables at first; every fourth attempt adds one.
        count = F.least(F.lit(30), F.lit(4) + F.floor(F.col("attempt") / 4)).cast("int")
        table = F.array(*map(F.lit, _SYLLABLES[script_]))
        picked = F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.get(table, F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("int")),
        )
        return F.concat(F.array_join(picked, ""), F.lit(_ENDINGS[script_, kind]))

    made = F.when(F.col("kind") == "email", email).when(F.col("kind") == "secret", hexes)
    made = made.when(F.col("kind") == "ip", ip).when(F.col("kind") == "iban", iban).when(F.col("kind") == "card", card)
    for script_, kind in _ENDINGS:
        made = made.when((F.col("kind") == f"name-{kind}") & (script == script_), name(script_, kind))
    return made.otherwise(plain)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities; surrogates are distinct and new."""
    table = entities.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        drawn = write_through(table.withColumn("surrogate", _draw(key)), "pii-surrogates")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("first"))
        real = entities.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
        again = F.col("real").isNotNull() | (F.col("first") != F.col("form"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        lost = checked.where(again).select("kind", "form", F.lit(1).alias("more"))
        if lost.isEmpty():
            return drawn.select("kind", "form", "surrogate")
        table = drawn.join(lost, ["kind", "form"], "left").select(
            "kind", "form", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")
        )
    raise RuntimeError("some kind of entity has more values than surrogates of its format")


def _rendered() -> Column:
    """A surrogate in the format of one mention."""
    mention, made = F.col("mention"), F.col("surrogate")
    gaps = F.split(mention, "[0-9]")
    digits = F.array_join(F.zip_with(gaps, F.split(made, ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # A bank account number is written in blocks of four, or in one.
    spaced = F.when(F.contains(mention, F.lit(" ")), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(made)).otherwise(made)
    return (
        F.when(F.col("kind").isin("email", "secret"), cased)
        .when(F.col("kind") == "ip", made)
        .when(F.col("kind") == "iban", spaced)
        .when(F.col("kind").startswith("name"), F.initcap(made))
        .otherwise(digits)
    )


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """Documents with text replaced and n_entities added."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_entities"])
    found = write_through(mentions(docs), "pii-entities")
    table = surrogates(found.select("kind", "form").distinct(), key)
    made = found.join(table, ["kind", "form"]).select("_k1", "_k2", "at", "part", _rendered().alias("new"), "form")
    # The words of a name come together again, after its title.
    new = (
        made.groupBy("_k1", "_k2", "at")
        .agg(F.sort_array(F.collect_list(F.struct("part", "new", "form"))).alias("parts"))
        .groupBy("_k1", "_k2")
        .agg(F.sort_array(F.collect_list(F.struct("at", "parts"))).alias("_new"))
    )
    # Columns of this work have a beginning that no column of the input has.
    w = "_"
    while any(c.lower().startswith(w) for c in docs.columns):
        w += "_"
    k1, k2, new_, gaps, old_, names, later_ = (f"{w}{c}" for c in ("k1", "k2", "new", "gaps", "old", "names", "later"))
    new = new.toDF(k1, k2, new_)
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    joined = docs.select("*", *[c.alias(n) for c, n in zip(_key(), (k1, k2))]).join(new, [k1, k2], "left")
    joined = joined.select(
        *columns, "text", new_,
        F.when(F.size(new_) > 0, F.split("text", ANY)).alias(gaps),
        F.when(F.size(new_) > 0, F.regexp_extract_all("text", F.lit(ANY), 0)).alias(old_),
    )
    title = lambda old: F.regexp_extract(old, r"^\p{L}+\.? ", 0)
    shown = F.zip_with(
        new_,
        old_,
        lambda x, old: F.concat(
            F.when(F.get(x["parts"], F.lit(0))["part"] > 0, title(old)).otherwise(F.lit("")),
            F.array_join(F.transform(x["parts"], lambda p: p["new"]), " "),
        ),
    )
    # Words of the text's names that stand elsewhere in it without a title.
    parts = F.filter(F.flatten(F.transform(new_, lambda x: x["parts"])), lambda p: p["part"] > 0)
    joined = joined.withColumn(names, F.array_distinct(F.transform(parts, lambda p: F.struct(p["form"], p["new"]))))
    named = F.size(names) > 0
    place = lambda word: F.array_position(F.col(f"{names}.form"), F.lower(word)).cast("int")
    lone = lambda gap: F.regexp_extract_all(gap, F.lit(_LONE), 0)
    renamed = lambda word: F.when(place(word) > 0, F.get(F.col(f"{names}.new"), place(word) - 1)).otherwise(word)
    cleared = lambda gap: F.array_join(
        F.zip_with(F.split(gap, _LONE), lone(gap), lambda a, b: F.concat(a, F.coalesce(renamed(b), F.lit("")))), ""
    )
    later = F.aggregate(
        F.transform(gaps, lambda gap: F.size(F.filter(lone(gap), lambda word: place(word) > 0))), F.lit(0), lambda a, x: a + x
    )
    joined = joined.withColumn(later_, F.when(named, later).otherwise(0))
    joined = joined.withColumn(gaps, F.when(F.col(later_) > 0, F.transform(gaps, cleared)).otherwise(F.col(gaps)))
    text = F.array_join(F.zip_with(gaps, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.select(
        *columns,
        F.coalesce(text, "text").alias("text"),
        (F.coalesce(F.size(new_), F.lit(0)) + F.col(later_)).cast("long").alias("n_entities"),
    )


# The key of the registered query; a user passes a secret of their own.
QUERY_KEY = "surrogates-1"


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, QUERY_KEY)
