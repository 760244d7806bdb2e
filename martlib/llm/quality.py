"""Quality rules whose cutoffs come with a proven bound on false rejections.

Every whole text gets counts; a *signal* is one count in thousandths of another. The rules form
one nested ladder: step i rejects a document that is above the i-th cutoff of any signal, and the
cutoffs fall from lenient to strict. Per stratum (language) the ladder is walked on the labelled
documents, and a step is taken only while the exact binomial test shows that the rate of good
documents it rejects is under ``RISK``: P(Bin(n, risk) <= rejected) <= level. Testing in a fixed
order needs no correction along the ladder, and one ladder for all signals none between them; the
level is ``DELTA`` divided by the number of strata (Bonferroni). So with probability 1 - DELTA no
stratum loses more than RISK of its good documents. About 60 good labels without a false
rejection prove a step in a single stratum, 90 in each of four; a stratum with fewer, or with a first step
that is not proven, is judged by the base rule alone, and :func:`risk_controlled_cutoffs` shows
it with a null step.

Only DataFrame functions; documents are not shuffled, the counts of labelled documents are.
Repeated 8-word windows are found inside the row: window hashes, sorted with their places.

Defined cases: null text has no words; fewer than 20 words fail the base rule; null and empty
lang are one stratum; labels with a null or with two different values for a document are
ignored, as are repeats; documents that share an id share its label; empty labels reject
nothing; extra columns of the documents are kept, those named like an output, ``quality_stratum``
or ``quality_step`` are replaced or dropped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlib.storage import write_through

RISK = 0.05
DELTA = 0.05
MIN_WORDS = 20
REPEAT_PCT = 30
WINDOW = 8

SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# signal: (count, per, cutoffs in thousandths, one per step of the ladder)
SIGNALS = {
    "symbols": ("n_symbols", "n_words", (2000, 1500, 1000, 800, 600, 500, 400, 300, 250, 200, 150, 100)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 650, 600, 550, 500, 450, 400, 350, 320, 300)),
    "repeats": ("n_repeat_words", "n_words", (300, 280, 260, 240, 220, 200, 180, 160, 140, 120, 110, 100)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150)),
    "word_length": (
        "word_chars", "n_words",
        (40000, 30000, 25000, 22000, 20000, 18000, 16000, 14000, 13000, 12000, 11000, 10000),
    ),
}
STEPS = 12

_STRATUM = "quality_stratum"
_STEP = "quality_step"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_capitals"]

# Terms of a binomial tail that are added one by one; the rest is bounded from above.
_TERMS = 4096


def _removed(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of every whole text, and base_failed."""
    made = [*COUNTS, *_MORE, "base_failed"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    # Columns of this work have a beginning that no column of the input has.
    w = "_"
    while any(c.lower().startswith(w) for c in docs.columns):
        w += "_"
    h_, lines_, w_, s_, p_ = (f"{w}{c}" for c in ("h", "lines", "w", "s", "p"))
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(
        "*",
        F.transform(words, lambda w: F.xxhash64(w)).alias(h_),
        lines.alias(lines_),
        (F.length(text) - _removed(text, SPACES)).cast("long").alias("word_chars"),
        _removed(text, "#*$%&|<>").alias("n_symbols"),
        _removed(text, _UPPER).alias("n_capitals"),
    )
    counts = ["word_chars", "n_symbols", "n_capitals"]
    windows = F.when(
        F.size(h_) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(h_) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h_, i, WINDOW))),
    )
    found = found.select(
        *kept,
        *counts,
        F.size(h_).cast("long").alias("n_words"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        windows.alias(w_),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    # Windows sorted with their places, only where any repeats.
    again = F.size(F.array_distinct(w_)) < F.size(w_)
    pairs = F.sort_array(F.transform(w_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.select(*kept, *counts, F.when(again, pairs).alias(s_))
    equal = F.zip_with(
        F.slice(s_, 1, F.size(s_) - 1),
        F.slice(s_, 2, F.size(s_)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    found = found.select(*kept, *counts, places.alias(p_))
    covered = F.aggregate(
        p_,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
    )
    found = found.select(*kept, *counts, F.coalesce(covered["n"], F.lit(0)).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PCT)
    return found.withColumn("base_failed", failed)


def rejected_at(step: int) -> Column:
    """Whether a document is above any signal's cutoff of one step."""
    return reduce(
        lambda a, b: a | b, [F.col(count) * 1000 > F.col(per) * cutoffs[step] for count, per, cutoffs in SIGNALS.values()]
    )


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series ten places further up, exact to about 1e-12."""
    y = x + 10.0
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = F.lit(1.0)
    for i in range(1, 11):
        product = product * (x + float(i))
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k up to n p, from the largest term down; 1 for larger k.

    The terms fall from k downwards. After _TERMS of them the rest is bounded by a geometric
    series, so the value is never too small.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    steps = F.sequence(F.lit(0), F.least(k, F.lit(_TERMS)).cast("int"))
    # a: sum of terms over the largest, and the next term over the largest.
    state = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - i) / (n - k + i + 1.0) * odds).alias("term")
        ),
    )
    ratio = F.greatest(F.lit(0.0), k - _TERMS) / (n - k + float(_TERMS)) * odds
    total = state["sum"] + F.when(k > _TERMS, state["term"] / (1 - ratio)).otherwise(0.0)
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def risk_controlled_cutoffs(
    counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """(stratum, n, step, one cutoff per signal), null where none is proven, from labelled documents."""
    agreed = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = 1 AND high = 1")
        .select("doc_id")
    )
    good = counted.join(agreed, "doc_id", "left_semi").where("NOT base_failed")
    sums = [F.count_if(rejected_at(i)).alias(f"k{i}") for i in range(STEPS)]
    table = good.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), *sums)
    table = write_through(table, "quality-counts")
    level = delta / max(1, table.count())
    # The test is one expression for all steps, and each select uses what the one before has made.
    rejected = F.array(*[f"k{i}" for i in range(STEPS)])
    proven = F.transform(rejected, lambda k: binomial_tail(F.col("n"), k, risk) <= level)
    # Up to the first step that is not proven.
    table = table.select("stratum", "n", F.coalesce(F.array_position(proven, False), F.lit(0)).alias("failed"))
    last = F.when(F.col("failed") == 0, F.lit(STEPS)).otherwise(F.col("failed") - 1).cast("int") - 1
    table = table.select("stratum", "n", last.alias("last"))
    step = F.when(F.col("last") >= 0, F.col("last"))
    cut = lambda cutoffs: F.get(F.array(*map(F.lit, cutoffs)), step)
    return table.select("stratum", "n", step.alias("step"), *[cut(c).alias(f"cut_{s}") for s, (_, _, c) in SIGNALS.items()])


def verdicts_of(counted: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds kept to documents with counts, which are written once and read twice."""
    counted = counted.drop(*[c for c in counted.columns if c.lower() in ("kept", _STRATUM, _STEP)])
    counted = write_through(counted, "quality-signals")
    steps = risk_controlled_cutoffs(counted, labels, stratum).select(F.col("stratum").alias(_STRATUM), F.col("step").alias(_STEP))
    rejected = reduce(lambda a, i: a.when(F.col(_STEP) == i, rejected_at(i)), range(1, STEPS), F.when(F.col(_STEP) == 0, rejected_at(0)))
    columns = [F.col(f"`{c}`") for c in counted.columns]
    matched = F.coalesce(F.col(stratum), F.lit("")) == F.col(_STRATUM)
    kept = ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))
    return counted.join(steps, matched, "left").select(*columns, kept.alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return verdicts_of(with_counts(docs).drop("text"), labels).select("doc_id", *COUNTS, "base_failed", "kept")
