"""URL filter by the likelihood ratio of two character language models.

Rules (host and path prefix, the longest that fits wins) decide what they can; the rest is
judged by two smoothed variable-order Markov models, one of URLs that rules allow and one of
URLs that rules block. A character's probability mixes all context lengths from 0 to
``ORDER``, each weighted by how often its context was seen against how many characters
followed it (Witten-Bell). The score is the log-likelihood difference per character; the
cutoff is the one with the best balanced accuracy on labelled URLs held out of the counts.

A URL is scored as two strings, its host and what follows. Each distinct string is counted once
with its number of rows, so a host that a third of all rows have costs one string. Counts are
gathered from all labelled URLs as distinct windows of ORDER + 1 characters, from which the
shorter contexts are summed; only distinct windows are joined with counts.

Defined cases: a null url and one without "://" have empty host and path, fit no rule and
score nothing (allowed); without labelled URLs of both kinds everything unruled is allowed;
a null page_id stays null; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.storage import write_through

# Verdict, host with its subdomains, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
# One labelled URL in this many is held out for the cutoff.
HELD_OUT = 5
# Scores per character are counted in bins of this width; differences beyond the ends share one.
BIN = 0.01
BINS = 1000

_START = "\u0001"
_CHARS = 256.0


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, and tail: all that follows the host."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    got = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return got.select(
        "page_id",
        lower.alias("host"),
        F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("_rest", "(?s)^[^/?#]*(.*)$", 1).alias("tail"),
    )


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled: the longest rule that fits, and what it says."""
    rule = said = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    null = F.lit(None).cast("string")
    return urls.withColumns({"rule": null if rule is None else rule, "ruled": null if said is None else said})


def _windows(text: Column, order: int) -> Column:
    """The character at each place of a text with the ``order`` before it."""
    padded = F.concat(F.lit(_START * order), text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))


def _scored_windows(windows: DataFrame, order: int) -> DataFrame:
    """(window, diff): log-likelihood difference of its last character after the others.

    ``windows`` has each distinct window with its counts in allowed and blocked URLs.
    """
    long = windows.select(
        "window", "good", "bad", F.explode(F.array(*map(F.lit, range(order + 1)))).alias("k")
    ).withColumns(
        {
            "gram": F.expr("right(window, k + 1)"),
            "context": F.expr(f"substring(window, {order + 1} - k, k)"),
        }
    )
    grams = long.groupBy("k", "gram", "context").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    contexts = grams.groupBy("k", "context").agg(
        F.sum("g").alias("ng"),
        F.sum("b").alias("nb"),
        F.count_if(F.col("g") > 0).alias("tg"),
        F.count_if(F.col("b") > 0).alias("tb"),
    )
    known = grams.join(contexts, ["k", "context"]).select("k", "gram", "g", "b", "ng", "nb", "tg", "tb")
    stacked = (
        long.select("window", "k", "gram")
        .join(known, ["k", "gram"])
        .groupBy("window")
        .agg(F.sort_array(F.collect_list(F.struct("k", "g", "b", "ng", "nb", "tg", "tb"))).alias("orders"))
    )

    def likelihood(count: str, total: str, kinds: str) -> Column:
        # A context never seen leaves the shorter one's probability as it is.
        return F.aggregate(
            "orders",
            F.lit(1.0 / _CHARS),
            lambda p, x: F.when(
                x[total] > 0, (x[count] + x[kinds] * p) / (x[total] + x[kinds]).cast("double")
            ).otherwise(p),
        )

    diff = F.log(likelihood("g", "ng", "tg")) - F.log(likelihood("b", "nb", "tb"))
    return stacked.select("window", diff.alias("diff"))


def _cutoff(scored: DataFrame) -> float | None:
    """Score at or above which a URL is allowed: best balanced accuracy, then the lowest."""
    binned = scored.select(
        F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).alias("bin"), "ruled"
    )
    table = binned.groupBy("bin").agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    # At most 2 BINS + 1 rows, whatever the data.
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = table.select(
        "bin",
        (
            1
            - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(every)
            + F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(every)
        ).alias("quality"),
    )
    best = ranked.where("quality IS NOT NULL").orderBy(F.desc("quality"), "bin").first()
    return None if best is None else best["bin"] * BIN


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, and score (null where nothing was scored)."""
    urls = write_through(with_rules(parts(pages), rules), "urls")
    held = F.pmod(F.xxhash64("host", "tail"), F.lit(HELD_OUT)) == 0
    learn = F.col("ruled").isNotNull() & ~held
    # Distinct strings with the number of labelled rows to learn from.
    strings = None
    for column in ("host", "tail"):
        own = urls.groupBy(F.col(column).alias("text")).agg(
            F.count_if(learn & (F.col("ruled") == "allow")).alias("good"),
            F.count_if(learn & (F.col("ruled") == "block")).alias("bad"),
        )
        own = own.where("text <> ''").withColumn("part", F.lit(column))
        strings = own if strings is None else strings.unionByName(own)
    places = strings.select("part", "text", "good", "bad", F.explode(_windows(F.col("text"), order)).alias("window"))
    windows = write_through(
        places.groupBy("window").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-windows"
    )
    diffs = _scored_windows(windows, order)
    sums = write_through(
        places.join(diffs, "window").groupBy("part", "text").agg(F.sum("diff").alias("sum")), "url-scores"
    )

    def of(part: str) -> DataFrame:
        return sums.where(F.col("part") == part).select(F.col("text").alias(part), F.col("sum").alias(f"{part}_sum"))

    length = F.length("host") + F.length("tail")
    score = (F.coalesce("host_sum", F.lit(0.0)) + F.coalesce("tail_sum", F.lit(0.0))) / length
    scored = (
        urls.join(of("host"), "host", "left")
        .join(of("tail"), "tail", "left")
        .withColumn("score", F.when(length > 0, score))
    )
    cutoff = _cutoff(scored.where(F.col("ruled").isNotNull() & held & F.col("score").isNotNull()))
    model = F.lit("allow")
    if cutoff is not None:
        model = F.when(F.col("score") < cutoff, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
