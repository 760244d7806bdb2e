"""The cleaning pass raw -> clean rows, and the split into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlib.functions import cleaning as C
from martlib.operators.ids import TIE

CLEAN_COLUMNS = [
    "week_date",
    "week_number",
    "month_number",
    "calendar_year",
    "region",
    "platform",
    "segment_code",
    "demographic",
    "age_band",
    "customer_type",
    "transactions",
    "sales",
    "avg_transaction",
]


def clean_weekly_sales(raw: DataFrame, week_rule: str = "monday_w1") -> DataFrame:
    """Every raw row cleaned in one projection; what cannot be cleaned becomes null.

    ``raw_week_date`` keeps the original date text for the reject table. A tie tag
    (see ``mark_ties``) passes through.
    """
    tie = [c for c in raw.columns if c == TIE]
    parsed = raw.select(
        C.parse_week_date(F.col("week_date")).alias("week_date"),
        C.upper_name(F.col("region")).alias("region"),
        C.plain_name(F.col("platform")).alias("platform"),
        C.segment_code(F.col("segment")).alias("segment_code"),
        C.plain_name(F.col("customer_type")).alias("customer_type"),
        "transactions",
        "sales",
        F.col("week_date").alias("raw_week_date"),
        *tie,
    )
    return parsed.select(*_derived(week_rule), "raw_week_date", *tie)


def _derived(week_rule: str) -> list:
    d, code = F.col("week_date"), F.col("segment_code")
    made = {
        "week_number": C.week_number(d, week_rule),
        "month_number": C.month_number(d),
        "calendar_year": C.calendar_year(d),
        "demographic": C.demographic(code),
        "age_band": C.age_band(code),
        "avg_transaction": C.avg_transaction(F.col("sales"), F.col("transactions")),
    }
    return [made[c].alias(c) if c in made else F.col(c) for c in CLEAN_COLUMNS]


def reject_reason():
    """First reason a clean row cannot enter the fact; null for a good row."""
    return (
        F.when(F.col("week_date").isNull(), "week_date")
        .when(F.col("region").isNull(), "region")
        .when(F.col("platform").isNull(), "platform")
        .when(F.col("customer_type").isNull(), "customer_type")
        .when(F.col("transactions").isNull(), "transactions")
        .when(F.col("sales").isNull(), "sales")
    )


def split_rejects(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reject_reason``); both are lazy filters."""
    marked = clean.withColumn("reject_reason", reject_reason())
    tie = [c for c in clean.columns if c == TIE]
    accepted = marked.filter(F.col("reject_reason").isNull()).select(*CLEAN_COLUMNS, *tie)
    return accepted, marked.filter(F.col("reject_reason").isNotNull()).drop(*tie)
