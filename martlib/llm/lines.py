"""Line dedup by distinct-site spread.

Lines are the newline-split parts of a text that hold a word. Every line gets a 128-bit hash;
per hash one aggregation merges HyperLogLog sketches of the sites (sources) it stands on, so a
line that a third of all rows have is combined inside each task before any shuffle. Lines
whose estimate lies near ``MIN_SITES`` get an exact distinct count, over those lines only;
estimates clear of it decide by themselves. A line on MIN_SITES sites or more is cross-site
boilerplate and goes from every document but the one with the least doc_id, where its first
place stays.

Where single rows of a line are needed again, its rows are dealt to ``SALTS`` parts by document and
place, and the few looked-up lines are repeated for each part: no line is in one task alone.

Only DataFrame functions. A document's removed places come back as one array, and its text is
rebuilt inside the row.

Defined cases: null and empty texts have no lines and stay as they are; a null source is no
site; documents with a null doc_id come after all others; repeated rows lose the same lines;
blank lines are never boilerplate; extra columns are kept, those named like an output are
replaced; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
# Sketches of 2^12 registers: 1.6 % standard error, four of them and at least two sites are near.
LG_REGISTERS = 12
NEAR = 0.065
NEAR_SITES = 2
# Parts of the rows of every line in joins by line.
SALTS = 32

SPACES = " \t\n\x0b\f\r"
_OUT = ("n_lines", "n_removed", "clean_text")


def _hash(c: str) -> list:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), F.col(c)).alias("h2")]


def _key() -> list:
    return [
        F.xxhash64("doc_id", "text").alias("_k1"),
        F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("_k2"),
    ]


def _salt(*of: str):
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int").alias("salt")


def _salted(lines: DataFrame) -> DataFrame:
    """Each looked-up line once per part."""
    return lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(h1, h2, first): hashes of lines on many sites, and the least document that has them."""
    lines = (
        docs.select("doc_id", F.col(site).cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .where(F.btrim("line", F.lit(SPACES)) != "")
        .select("doc_id", "site", *_hash("line"))
    )
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch"), F.min("doc_id").alias("first")
    )
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(NEAR_SITES, NEAR * min_sites)
    spread = spread.where(F.col("sites") >= min_sites - margin)
    near = F.col("sites") <= min_sites + margin
    exact = (
        lines.select("h1", "h2", "site", _salt("doc_id", "site"))
        .join(_salted(spread.where(near).select("h1", "h2")), ["h1", "h2", "salt"], "left_semi")
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    sure = spread.where(~near).select("h1", "h2", "first")
    return sure.unionByName(spread.where(near).join(exact.drop("exact"), ["h1", "h2"]).select("h1", "h2", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Documents with n_lines (with a word), n_removed, and clean_text."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (*_OUT, "_k1", "_k2", "_gone", "_lines")])
    lines = (
        docs.select(*_key(), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.btrim("line", F.lit(SPACES)) != "")
        .select("_k1", "_k2", "doc_id", "pos", *_hash("line"), _salt("_k1", "pos"))
    )
    # One row per document and boilerplate line; the first place stays in the first document.
    gone = (
        lines.join(_salted(boilerplate(docs, min_sites, site)), ["h1", "h2", "salt"])
        .groupBy("_k1", "_k2", "h1", "h2")
        .agg(F.collect_set("pos").alias("at"), F.max(F.col("doc_id").eqNullSafe(F.col("first"))).alias("own"))
        .select(
            "_k1",
            "_k2",
            F.when(F.col("own"), F.array_except("at", F.array(F.array_min("at")))).otherwise(F.col("at")).alias("at"),
        )
        .groupBy("_k1", "_k2")
        .agg(F.flatten(F.collect_list("at")).alias("_gone"))
    )
    columns = docs.columns
    joined = docs.select("*", *_key()).join(gone, ["_k1", "_k2"], "left")
    cut = joined.select(*columns, "_gone", F.split("text", "\n").alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    word_lines = F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return cut.select(
        *columns,
        F.coalesce(F.size(word_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.size("_gone") > 0, F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
        .otherwise(F.col("text"))
        .alias("clean_text"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("text_sha256")
    )
