"""Weekly (region, platform) panel and its leak-free features.

A window partition is one series: at most one row per calendar week, whatever the
size of the fact, because the panel is aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions import cleaning as C
from martlib.operators.bi import rollup_sum
from martlib.operators.star import Star

SERIES = ["region", "platform"]
DATE = "week_date"
TARGET = "sales"

# The feature set.
LAGS = [1, 2, 3, 4, 8, 12]
MEAN_WINDOWS = {4: 2, 8: 4, 12: 4}  # rows -> least rows needed
STD_WINDOWS = {4: 2, 8: 4}
BASE_FEATURES = (
    [f"lag_{k}" for k in LAGS]
    + [f"rolling_mean_{k}" for k in MEAN_WINDOWS]
    + [f"rolling_std_{k}" for k in STD_WINDOWS]
    + ["week_number", "month_number", "quarter", "calendar_year"]
    + ["transactions", "is_packaging_week"]
)

# Names of one series column that get a 0/1 column each.
MAX_LEVELS = 1000


def panel_weekly(star: Star) -> DataFrame:
    """Weekly sums per series; sales in millions, transactions in thousands."""
    calendar = ["week_date", "week_number", "month_number", "calendar_year"]
    totals = rollup_sum(
        star, [*calendar, "region_name", "platform_name"], ["sales", "transactions"]
    )
    return totals.select(
        "week_date",
        F.col("region_name").alias("region"),
        F.col("platform_name").alias("platform"),
        "week_number",
        "month_number",
        "calendar_year",
        (F.col("sales").cast("double") / 1e6).alias("sales"),
        (F.col("transactions").cast("double") / 1e3).alias("transactions"),
    )


def densify(panel: DataFrame, week_rule: str = "monday_w1") -> DataFrame:
    """Opt-in: fills missing weeks of each series with zero, between its first and last week."""
    spans = panel.groupBy(*SERIES).agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    weeks = spans.select(
        *SERIES, F.explode(F.expr("sequence(first, last, interval 7 days)")).alias(DATE)
    )
    full = weeks.join(panel.select(*SERIES, DATE, "sales", "transactions"), [*SERIES, DATE], "left")
    d = F.col(DATE)
    return full.select(
        DATE,
        *SERIES,
        C.week_number(d, week_rule).alias("week_number"),
        C.month_number(d).alias("month_number"),
        C.calendar_year(d).alias("calendar_year"),
        F.coalesce("sales", F.lit(0.0)).alias("sales"),
        F.coalesce("transactions", F.lit(0.0)).alias("transactions"),
    )


def _series_window():
    return Window.partitionBy(*SERIES).orderBy(DATE)


def add_lags(panel: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    """Positional lags: k rows back in the series, not k calendar weeks."""
    w = _series_window()
    return panel.withColumns({f"lag_{k}": F.lag(TARGET, k).over(w) for k in lags})


def _past(aggregate, rows: int, least: int) -> Column:
    """``aggregate`` over the ``rows`` before the current one; null with fewer than ``least``."""
    w = _series_window().rowsBetween(-rows, -1)
    return F.when(F.count(TARGET).over(w) >= least, aggregate(TARGET).over(w))


def add_rolling_mean(panel: DataFrame, windows: dict[int, int] = MEAN_WINDOWS) -> DataFrame:
    return panel.withColumns(
        {f"rolling_mean_{k}": _past(F.avg, k, least) for k, least in windows.items()}
    )


def add_rolling_std(panel: DataFrame, windows: dict[int, int] = STD_WINDOWS) -> DataFrame:
    return panel.withColumns(
        {f"rolling_std_{k}": _past(F.stddev_samp, k, least) for k, least in windows.items()}
    )


def intervention_flag(week: Column, year: Column, from_week: int, in_year: int) -> Column:
    """1 from ``from_week`` on within ``in_year`` only, else 0."""
    return ((week >= from_week) & (year == in_year)).cast("int")


def drop_warmup(df: DataFrame) -> DataFrame:
    """Drops rows with any missing feature: the first weeks of each series."""
    return df.dropna(subset=BASE_FEATURES)


def engineer_features(panel: DataFrame, in_year: int = 2020, from_week: int = 25) -> DataFrame:
    """All features from one shuffle and one sort of the panel by series and week."""
    made = add_rolling_std(add_rolling_mean(add_lags(panel)))
    made = made.withColumns(
        {
            "quarter": C.quarter(F.col(DATE)),
            "is_packaging_week": intervention_flag(
                F.col("week_number"), F.col("calendar_year"), from_week, in_year
            ),
            "naive_pred": F.col("lag_1"),
        }
    )
    return drop_warmup(made)


def _levels(dim: DataFrame, column: str) -> list[str]:
    """Sorted distinct names; more than MAX_LEVELS are an error, and are not fetched."""
    names = [r[0] for r in dim.select(column).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(names) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} names, too many for a column each")
    return sorted(names)


def dummy_levels(star: Star) -> dict[str, list[str]]:
    """Sorted names per series column, from the dimension tables."""
    return {
        "region": _levels(star.dim_region, "region_name"),
        "platform": _levels(star.dim_platform, "platform_name"),
    }


def encode_dummies(
    df: DataFrame, levels: dict[str, list[str]]
) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all but the alphabetically first level; also all feature columns.

    For people to read: the model encodes its series itself, as one sparse vector.
    """
    dummies = {
        f"{column}_{name}": (F.col(column) == name).cast("int")
        for column, names in levels.items()
        for name in sorted(names)[1:]
    }
    return df.withColumns(dummies), BASE_FEATURES + list(dummies)


def split(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(rows before ``date``, rows from ``date`` on)."""
    at = F.lit(date).cast("date")
    return df.filter(F.col(DATE) < at), df.filter(F.col(DATE) >= at)


def panel_profile(df: DataFrame) -> DataFrame:
    """One row: rows, series, weeks and the date range."""
    per_series = df.groupBy(*SERIES, DATE).agg(F.count("*").alias("n"))
    weeks = per_series.agg(
        F.sum("n").alias("row_count"),
        F.count_distinct(*SERIES).alias("series_count"),
        F.count_distinct(DATE).alias("week_count"),
        F.min(DATE).alias("first_week"),
        F.max(DATE).alias("last_week"),
    )
    return weeks
