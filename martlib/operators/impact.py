"""Before/after comparison around an event, by anchor date or by fixed week ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions.measures import percent_change
from martlib.operators.bi import ratio_of_sums, rollup_sum
from martlib.operators.star import Star

BEFORE, AFTER = "before", "after"


def anchor_week(star: Star, anchor: date) -> Column:
    """Week number of the anchor date as a scalar subquery; null when the data lacks that date.

    The year filter prunes partitions; the fact is ordered by week, so few row groups are read.
    """
    rows = star.fact.filter(
        (F.col("calendar_year") == anchor.year) & (F.col("week_date") == F.lit(anchor))
    )
    return rows.agg(F.max("week_number")).scalar()


def labelled(star: Star, anchor: date, weeks: int, year: int | None = None) -> DataFrame:
    """Fact rows of the ``weeks`` before and after the anchor week, with ``period``.

    Windows use the week number, so they never cross a year end. ``year=None`` keeps every
    year. Rows outside both windows are filtered before any aggregation; without the anchor
    in the data the bounds are null and nothing is kept.
    """
    week = anchor_week(star, anchor)
    fact = star.fact if year is None else star.fact.filter(F.col("calendar_year") == year)
    return fact.filter(
        F.col("week_number").between(week - weeks, week + (weeks - 1))
    ).withColumn("period", F.when(F.col("week_number") < week, BEFORE).otherwise(AFTER))


def period_impact(
    star: Star,
    anchor: date,
    weeks: int,
    year: int | None = None,
    by: list[str] = (),
    digits: int = 2,
) -> DataFrame:
    """Long form: one row per period with the change from "before" to "after"."""
    by = list(by)
    totals = rollup_sum(star, [*by, "period"], fact=labelled(star, anchor, weeks, year))
    # At most two rows per group; "before" sorts first in descending text order.
    previous = F.lag("sales").over(Window.partitionBy(*by).orderBy(F.desc("period")))
    return (
        totals.withColumn("previous", previous)
        .withColumn("sales_change", F.col("sales") - F.col("previous"))
        .withColumn("pct_change", percent_change(F.col("sales"), F.col("previous"), digits))
        .select(*by, "period", F.col("sales").alias("total_sales"), "sales_change", "pct_change")
    )


def period_impact_by(
    star: Star, anchor: date, weeks: int, year: int, dim: str, digits: int = 2
) -> DataFrame:
    """Wide form: before, after, change and percent per value of ``dim``; a missing side is null."""
    totals = rollup_sum(star, [dim, "period"], fact=labelled(star, anchor, weeks, year))
    wide = totals.groupBy(dim).agg(
        F.sum(F.when(F.col("period") == BEFORE, F.col("sales"))).alias("before_sales"),
        F.sum(F.when(F.col("period") == AFTER, F.col("sales"))).alias("after_sales"),
    )
    return wide.withColumn(
        "sales_change", F.col("after_sales") - F.col("before_sales")
    ).withColumn(
        "pct_change", percent_change(F.col("after_sales"), F.col("before_sales"), digits)
    )


def window_label(side: str, weeks: tuple[int, int]) -> str:
    return f"{side} Change (Weeks {weeks[0]}\u2013{weeks[1]})"


def fixed_window_impact(
    star: Star, year: int, before: tuple[int, int], after: tuple[int, int], digits: int = 2
) -> DataFrame:
    """Sales, transactions and order value of two fixed week ranges of one year."""
    week = F.col("week_number")
    fact = star.fact.filter(
        (F.col("calendar_year") == year) & (week.between(*before) | week.between(*after))
    ).withColumn(
        "period",
        F.when(week.between(*before), window_label("Before", before)).otherwise(
            window_label("After", after)
        ),
    )
    totals = rollup_sum(star, ["period"], ["sales", "transactions"], fact=fact).select(
        "period",
        F.col("sales").alias("total_sales"),
        F.col("transactions").alias("total_transactions"),
    )
    return ratio_of_sums(totals, "total_sales", "total_transactions", "avg_transaction", digits)


def fixed_window_kpis(
    star: Star, year: int, before: tuple[int, int], after: tuple[int, int], digits: int = 2
) -> DataFrame:
    """One row: sales before, sales after, difference, percent."""
    week = F.col("week_number")
    sides = star.fact.filter(
        (F.col("calendar_year") == year) & week.between(before[0], after[1])
    ).agg(
        F.sum(F.when(week.between(*before), F.col("sales"))).alias("before_sales"),
        F.sum(F.when(week.between(*after), F.col("sales"))).alias("after_sales"),
    )
    return sides.withColumn(
        "sales_change", F.col("after_sales") - F.col("before_sales")
    ).withColumn(
        "pct_change", percent_change(F.col("after_sales"), F.col("before_sales"), digits)
    )
