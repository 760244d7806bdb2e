"""Generic BI operators. Every catalogue query is an instance of these few functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions.measures import percent, percent_change, ratio
from martlib.operators.star import Star, mart

# Output column -> (dimension table, id column, dimension column).
DIMENSION_COLUMNS = {
    "region_name": ("dim_region", "region_id"),
    "platform_name": ("dim_platform", "platform_id"),
    "segment_code": ("dim_segment", "segment_id"),
    "age_band": ("dim_segment", "segment_id"),
    "demographic": ("dim_segment", "segment_id"),
}

# Additive measures: partial results may be summed again after the dimension join.
MEASURES = {
    "sales": F.sum,
    "transactions": F.sum,
    "avg_transaction": F.sum,
    "records": lambda _: F.count("*"),
}


def rollup_sum(
    star: Star,
    by: list[str],
    measures: list[str] = ("sales",),
    fact: DataFrame | None = None,
    dim_filter: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Sums of ``measures`` grouped by fact columns and dimension columns.

    The fact is aggregated on its integer keys first, so only one small row per key
    combination reaches the joins, and only the dimensions named in ``by`` (or needed
    by ``dim_filter``, which may use any column of a named dimension) are joined.
    ``fact`` replaces ``star.fact`` when the caller has filtered it or added columns.
    """
    fact = star.fact if fact is None else fact
    dims = dict(DIMENSION_COLUMNS[c] for c in by if c in DIMENSION_COLUMNS)
    own = [c for c in by if c not in DIMENSION_COLUMNS]
    totals = fact.groupBy(*own, *dims.values()).agg(
        *[MEASURES[m](m).alias(m) for m in measures]
    )
    if not dims:
        return totals
    for table, key in dims.items():
        totals = totals.join(star.table(table), key, how)
    if dim_filter is not None:
        totals = totals.filter(dim_filter)
    return totals.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def ratio_of_sums(
    df: DataFrame, numerator: str, denominator: str, out: str, digits: int = 2
) -> DataFrame:
    """Adds numerator/denominator of already summed columns; null when nothing to divide by."""
    return df.withColumn(out, ratio(F.col(numerator), F.col(denominator), digits))


def share_of(
    df: DataFrame, value: str, within: list[str], out: str, digits: int = 2
) -> DataFrame:
    """Adds each row's percentage of the group total, or of the grand total when ``within`` is empty.

    ``df`` is already aggregated, so a window partition holds one row per group member.
    The grand total is a scalar subquery; AQE reuses the aggregate's shuffle for it.
    """
    if within:
        total = F.sum(value).over(Window.partitionBy(*within))
    else:
        total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, percent(F.col(value), total, digits))


def growth(
    df: DataFrame,
    value: str,
    partition: list[str],
    order: list[str],
    previous: str,
    out: str,
    digits: int = 2,
) -> DataFrame:
    """Adds the previous row's value and the growth in percent (null for the first row).

    With no ``partition`` the window is unpartitioned: use it on calendar-sized results only.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn(previous, before).withColumn(
        out, percent_change(F.col(value), F.col(previous), digits)
    )


def rank_top(df: DataFrame, value: str, within: list[str], out: str, k: int = 1) -> DataFrame:
    """Rows ranked at most ``k`` by descending value inside each group; ties are kept."""
    w = Window.partitionBy(*within).orderBy(F.desc(value))
    return df.withColumn(out, F.rank().over(w)).filter(F.col(out) <= k)


def dense_ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """Dense rank by descending value over a dimension-sized result."""
    return df.withColumn(out, F.dense_rank().over(Window.orderBy(F.desc(value))))


def running_total(
    df: DataFrame, value: str, partition: list[str], order: str, out: str
) -> DataFrame:
    w = (
        Window.partitionBy(*partition)
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(out, F.sum(value).over(w))


def rolling_avg(
    df: DataFrame, value: str, partition: list[str], order: str, rows: int, out: str, digits: int = 2
) -> DataFrame:
    """Mean over the current row and the ``rows - 1`` rows before it."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, ratio(F.sum(value).over(w), F.count(value).over(w), digits))


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest rows, ties broken by key so the result is the same every time."""
    return df.orderBy(F.desc(value), key).limit(k)


def latest_rows(star: Star, k: int = 50, last_id: int | None = None) -> DataFrame:
    """The ``k`` rows of the analytical view with the highest ids.

    ``last_id`` is the highest id ever given (see ``read_high_water``). Ids follow the file
    order, so a bound just below it skips almost every row group; where deletes or missing
    dimension rows leave too few rows above it, it is lowered in growing steps.
    """
    if last_id is None:
        last_id = star.fact.agg(F.max("sales_id")).first()[0] or 0
    width = k
    while True:
        newest = replace(star, fact=star.fact.filter(F.col("sales_id") > last_id - width))
        if width >= last_id or mart(newest).limit(k).count() == k:
            return mart(newest).orderBy(F.desc("sales_id")).limit(k)
        width *= 8


def kpi_summary(star: Star, digits: int = 2) -> DataFrame:
    """One row: total sales, transactions, order value, number of regions."""
    per_region = star.fact.groupBy("region_id").agg(
        F.sum("sales").alias("sales"), F.sum("transactions").alias("transactions")
    )
    totals = per_region.agg(
        F.sum("sales").alias("total_sales"),
        F.sum("transactions").alias("total_transactions"),
        F.count("region_id").alias("total_regions"),
    )
    return ratio_of_sums(totals, "total_sales", "total_transactions", "avg_transaction", digits)
