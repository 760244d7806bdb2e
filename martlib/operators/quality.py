"""Calendar, completeness and aggregation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlib.functions.measures import ratio
from martlib.operators.bi import rollup_sum
from martlib.operators.star import Star


def week_start_days(star: Star) -> DataFrame:
    """Distinct weekday names of ``week_date``; one row means a consistent calendar."""
    weeks = star.fact.select("week_date").distinct()
    return weeks.select(F.date_format("week_date", "EEEE").alias("day_of_week")).distinct()


def missing_weeks(star: Star, first: int = 1, last: int = 52) -> DataFrame:
    """Week numbers of the range that never occur. The fact side is distinct before the join."""
    spark = star.fact.sparkSession
    wanted = spark.range(first, last + 1).select(F.col("id").cast("int").alias("week_number"))
    present = star.fact.select("week_number").distinct()
    return wanted.join(present, "week_number", "left_anti").select(
        F.col("week_number").alias("missing_week_number")
    )


def avg_of_avgs_vs_ratio(star: Star, digits: int = 2) -> DataFrame:
    """The misleading mean of row averages beside the right ratio of sums."""
    totals = rollup_sum(
        star,
        ["calendar_year", "platform_name"],
        ["avg_transaction", "records", "sales", "transactions"],
    )
    return totals.select(
        "calendar_year",
        F.col("platform_name").alias("platform"),
        ratio(F.col("avg_transaction"), F.col("records"), digits).alias("incorrect_avg_of_avgs"),
        ratio(F.col("sales"), F.col("transactions"), digits).alias("correct_avg_transaction"),
    )
