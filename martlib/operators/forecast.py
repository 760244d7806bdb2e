"""Recursive multi-step forecast: every series steps forward together, in narrow stages.

One row per series carries the last 12 values. A step computes features from them,
scores the model and pushes the prediction; no step shuffles. Steps depend on each
other, so the loop runs over the horizon (at most 24), never over series or rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions import cleaning as C
from martlib.operators.evaluate import select_market
from martlib.operators.model import PREDICTION, TreeModel, predict
from martlib.operators.panel import (
    DATE,
    LAGS,
    MEAN_WINDOWS,
    SERIES,
    STD_WINDOWS,
    TARGET,
    intervention_flag,
)
from martlib.storage import write_through

TAIL = max([*LAGS, *MEAN_WINDOWS, *STD_WINDOWS])

NO_DATE = date(1970, 1, 1)

# Steps planned together before the state is written out, so plans stay short.
STEPS_PER_PLAN = 12


def series_tails(panel: DataFrame) -> DataFrame:
    """Per series: its last ``TAIL`` values (oldest first), last transactions, last value.

    Rows beyond the tail are dropped before anything is collected, so an array never
    exceeds ``TAIL`` elements.
    """
    newest_first = Window.partitionBy(*SERIES).orderBy(F.desc(DATE))
    recent = panel.withColumn("_age", F.row_number().over(newest_first)).filter(
        F.col("_age") <= TAIL
    )
    rows = F.sort_array(F.collect_list(F.struct(DATE, TARGET)))
    return recent.groupBy(*SERIES).agg(
        F.transform(rows, lambda r: r[TARGET]).alias("history"),
        F.max_by("transactions", DATE).alias("last_transactions"),
        F.max_by(TARGET, DATE).alias("last_value"),
    )


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values).cast("double"))


def _std(values: Column, mean: Column, sample: bool) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    n = F.size(values).cast("double")
    return F.sqrt(F.try_divide(squares, n - 1.0 if sample else n))


def history_features(
    short_lag: str = "lag_1", sample_std: bool = True
) -> tuple[dict[str, Column], dict[str, Column]]:
    """Lags and means of the ``history`` array, then deviations, which use those means.

    When the history is shorter than a lag needs, ``short_lag`` chooses the last value
    ("lag_1") or zero ("zero"); a mean falls back to the mean of all, a deviation to 0.
    """
    history, size = F.col("history"), F.size("history")
    if short_lag == "lag_1":
        fallback = F.try_element_at(history, F.lit(-1))
    elif short_lag == "zero":
        fallback = F.lit(0.0)
    else:
        raise ValueError(f"unknown short_lag {short_lag!r}")

    def tail(k):
        return F.slice(history, -k, k)

    first = {
        f"lag_{k}": F.when(size >= k, F.try_element_at(history, F.lit(-k))).otherwise(fallback)
        for k in LAGS
    }
    for k in MEAN_WINDOWS:
        first[f"rolling_mean_{k}"] = F.when(size >= k, _mean(tail(k))).otherwise(_mean(history))
    second = {
        f"rolling_std_{k}": F.when(
            size >= k, _std(tail(k), F.col(f"rolling_mean_{k}"), sample_std)
        ).otherwise(0.0)
        for k in STD_WINDOWS
    }
    return first, second


def calendar_features(
    d: Column, week_rule: str, in_year: int, from_week: int
) -> dict[str, Column]:
    week, year = C.week_number(d, week_rule), C.calendar_year(d)
    return {
        "week_number": week,
        "month_number": C.month_number(d),
        "quarter": C.quarter(d),
        "calendar_year": year,
        "is_packaging_week": intervention_flag(week, year, from_week, in_year),
    }


def _score(model: TreeModel | Column, frame: DataFrame) -> DataFrame:
    """Predictions of a fitted model, or of a rule given as an expression of the features."""
    if isinstance(model, TreeModel):
        return predict(model, frame)
    return frame.withColumn(PREDICTION, F.greatest(model, F.lit(0.0)))


def _recurse(
    model: TreeModel | Column,
    state: DataFrame,
    horizon: int,
    step_date,
    step_transactions,
    in_year: int,
    from_week: int,
    week_rule: str,
    short_lag: str,
    sample_std: bool,
) -> DataFrame:
    """Adds ``preds``, one prediction per step; a step whose date is null leaves the state alone."""
    kept = [c for c in state.columns if c != "history"]
    # Column objects do not depend on the step, so they are built once.
    averages, deviations = history_features(short_lag, sample_std)
    grown = F.concat("history", F.array(PREDICTION))
    pushed = F.when(F.size(grown) > TAIL, F.slice(grown, -TAIL, TAIL)).otherwise(grown)
    longer = F.concat("preds", F.array(PREDICTION))

    state = state.withColumn("preds", F.array().cast("array<double>"))
    for step in range(1, horizon + 1):
        d = step_date(step)
        # A series without this step still needs valid inputs; its prediction is not kept.
        day = F.coalesce(d, F.lit(NO_DATE))
        frame = state.withColumns(
            {
                **averages,
                **calendar_features(day, week_rule, in_year, from_week),
                "transactions": step_transactions(step),
                "active": d.isNotNull(),
            }
        ).withColumns(deviations)
        state = _score(model, frame).select(
            *kept,
            F.when(F.col("active"), pushed).otherwise(F.col("history")).alias("history"),
            F.when(F.col("active"), longer).otherwise(F.col("preds")).alias("preds"),
        )
        # A rule's expression would be copied into every later step, so it is cut at once.
        if step < horizon and (step % STEPS_PER_PLAN == 0 or isinstance(model, Column)):
            state = write_through(state, f"forecast-step-{step}")
    return state


def future_calendar(panel: DataFrame, horizon: int, week_rule: str = "monday_w1") -> DataFrame:
    """The ``horizon`` weeks after the last week of the whole panel, with calendar parts."""
    last = panel.agg(F.max(DATE).alias("last"))
    steps = last.filter(F.col("last").isNotNull()).select(
        "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    )
    d = F.col(DATE)
    return steps.select("step", F.date_add("last", F.col("step") * 7).alias(DATE)).select(
        "step",
        DATE,
        C.week_number(d, week_rule).alias("week_number"),
        C.month_number(d).alias("month_number"),
        C.quarter(d).alias("quarter"),
        C.calendar_year(d).alias("calendar_year"),
    )


def forecast(
    model: TreeModel | Column,
    panel: DataFrame,
    horizon: int = 12,
    in_year: int = 2020,
    from_week: int = 25,
    week_rule: str = "monday_w1",
    short_lag: str = "zero",
    sample_std: bool = True,
    digits: int = 4,
) -> DataFrame:
    """Forecast of every series for the ``horizon`` weeks after the panel's last week.

    Future transactions are unknown; each series keeps its last known value.
    """
    state = series_tails(panel).withColumn("last_date", panel.agg(F.max(DATE)).scalar())
    done = _recurse(
        model,
        state,
        horizon,
        step_date=lambda k: F.date_add("last_date", 7 * k),
        step_transactions=lambda k: F.col("last_transactions"),
        in_year=in_year,
        from_week=from_week,
        week_rule=week_rule,
        short_lag=short_lag,
        sample_std=sample_std,
    )
    # An outer explode lets no filter be inferred, which would copy all steps' expressions.
    rows = done.select(*SERIES, "last_date", F.posexplode_outer("preds").alias("pos", "pred"))
    return rows.where("pos IS NOT NULL").select(
        F.date_add("last_date", (F.col("pos") + 1) * 7).alias(DATE),
        *SERIES,
        (F.col("pos") + 1).alias("step"),
        F.round("pred", digits).alias("forecast"),
    )


def backtest_recursive(
    model: TreeModel | Column,
    train: DataFrame,
    test: DataFrame,
    in_year: int = 2020,
    from_week: int = 25,
    transactions_policy: str = "last_value",
    week_rule: str = "monday_w1",
    short_lag: str = "lag_1",
    sample_std: bool = True,
) -> DataFrame:
    """Recursive forecast over each series' own test weeks, beside the constant naive value.

    ``transactions_policy="actual"`` feeds the test week's real transactions, which no
    forecaster would know; the default keeps the last training value.
    """
    if transactions_policy not in ("actual", "last_value"):
        raise ValueError(f"unknown transactions_policy {transactions_policy!r}")
    # One element per test week of a series: calendar-sized.
    future = test.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct(DATE, "transactions", TARGET))).alias("future")
    )
    horizon = future.agg(F.max(F.size("future"))).first()[0] or 0
    state = series_tails(train).join(future, SERIES)

    def ahead(step):
        return F.try_element_at("future", F.lit(step))

    def transactions(step):
        if transactions_policy == "actual":
            return F.coalesce(ahead(step)["transactions"], F.col("last_transactions"))
        return F.col("last_transactions")

    done = _recurse(
        model,
        state,
        horizon,
        step_date=lambda k: ahead(k)[DATE],
        step_transactions=transactions,
        in_year=in_year,
        from_week=from_week,
        week_rule=week_rule,
        short_lag=short_lag,
        sample_std=sample_std,
    )
    pairs = F.arrays_zip("future", "preds")
    rows = done.select(*SERIES, "last_value", F.posexplode_outer(pairs).alias("pos", "pair"))
    return rows.where("pos IS NOT NULL").select(
        F.col("pair.future")[DATE].alias(DATE),
        *SERIES,
        F.col("pair.future")[TARGET].alias(TARGET),
        F.col("pair.preds").alias("recursive_pred"),
        F.col("last_value").alias("naive_constant"),
        (F.col("pos") + 1).alias("step"),
    )


def forecast_total(
    forecasts: DataFrame, region: str | None = None, platform: str | None = None
) -> DataFrame:
    """Weekly total of the forecasts of the chosen market."""
    chosen = select_market(forecasts, region, platform)
    return chosen.groupBy(DATE).agg(F.sum("forecast").alias("forecast"))


def forecast_band(totals: DataFrame, width: float = 0.5) -> DataFrame:
    """A constant band of ``width`` sample deviations around the total forecast.

    ``totals`` has one row per forecast week, so the unpartitioned window is horizon-sized;
    it also evaluates the forecast once, where a join or subquery would run it twice.
    """
    half = F.stddev_samp("forecast").over(Window.partitionBy()) * width
    return totals.withColumn("_half", half).select(
        DATE,
        "forecast",
        (F.col("forecast") - F.col("_half")).alias("lower"),
        (F.col("forecast") + F.col("_half")).alias("upper"),
    )
