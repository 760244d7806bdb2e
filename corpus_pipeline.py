"""Corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of ``documents``; the last returns a row per packed piece.

Defined cases are those of the operators. Besides: a document that loses all its lines goes; of
rows that repeat a doc_id with the same text one stays; documents with a null doc_id are never
near duplicates and stay; n_chars is the length of the text as it is after a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.llm.decontaminate import decontaminate, verdicts
from martlib.llm.lines import remove_boilerplate
from martlib.llm.neardup import near_duplicates
from martlib.llm.packing import pack
from martlib.llm.quality import verdicts_of, with_counts
from martlib.storage import write_through

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_DUP_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return verdicts_of(with_counts(docs), labels).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts."""
    cut = remove_boilerplate(docs)
    some = F.coalesce(F.btrim("clean_text", F.lit(" \t\n\x0b\f\r")) != "", F.lit(False))
    changed = F.col("n_removed") > 0
    return cut.where(~changed | some).select(
        "doc_id",
        F.col("clean_text").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates."""
    kept = near_duplicates(docs, NEAR_DUP_WORDS).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(COLUMNS).unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return verdicts(decontaminate(docs.select(COLUMNS), items)).where("NOT contaminated").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Packing needs token ids, which SQL has not; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
