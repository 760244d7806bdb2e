"""Forecast metrics as aggregations: pooled, per series, per step ahead, weekly totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions.measures import r_squared, wape
from martlib.operators.panel import DATE, SERIES, TARGET
from martlib.operators.rank import exact_median

NAIVE = "naive_pred"


def _with_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """First pass of R2: the mean of the target beside each row."""
    if keys:
        return df.withColumn("_mean", F.avg(TARGET).over(Window.partitionBy(*keys)))
    return df.withColumn("_mean", df.agg(F.avg(TARGET)).scalar())


def pooled_metrics(df: DataFrame, pred: str, naive: str = NAIVE, digits: int = 2) -> DataFrame:
    """One row: R2 of ``pred``, WAPE of ``pred`` and of the naive forecast, improvement."""
    y = F.col(TARGET)
    sums = _with_mean(df, []).agg(
        r_squared(y, F.col(pred), F.col("_mean")).alias("r2"),
        wape(y, F.col(pred)).alias("model"),
        wape(y, F.col(naive)).alias("naive"),
    )
    return sums.select(
        F.round("r2", max(digits, 4)).alias("pooled_r2"),
        F.round("model", digits).alias("model_wape"),
        F.round("naive", digits).alias("naive_wape"),
        F.round(F.col("naive") - F.col("model"), digits).alias("wape_improvement"),
    )


def per_stream_metrics(
    df: DataFrame, pred: str, naive: str = NAIVE, digits: int | None = None
) -> DataFrame:
    """R2, WAPEs, MAE, mean and whether the model beats the naive forecast, per series.

    The comparison uses unrounded errors. The mean and the sums share one shuffle.
    ``digits=None`` rounds as the published tables do.
    """
    r2_digits, wape_digits, mae_digits, mean_digits = (
        (4, 2, 3, 2) if digits is None else (digits,) * 4
    )
    y = F.col(TARGET)
    sums = (
        _with_mean(df, SERIES)
        .groupBy(*SERIES)
        .agg(
            r_squared(y, F.col(pred), F.col("_mean")).alias("r2"),
            wape(y, F.col(pred)).alias("model"),
            wape(y, F.col(naive)).alias("naive"),
            F.avg(F.abs(y - F.col(pred))).alias("mae"),
            F.avg(y).alias("mean"),
        )
    )
    return sums.select(
        *SERIES,
        F.format_string("%s (%s)", "region", "platform").alias("stream"),
        F.round("r2", r2_digits).alias("r2"),
        F.round("model", wape_digits).alias("model_wape"),
        F.round("naive", wape_digits).alias("naive_wape"),
        (F.col("model") < F.col("naive")).alias("beat_naive"),
        F.round("mae", mae_digits).alias("mae_m"),
        F.round("mean", mean_digits).alias("mean_sales_m"),
    )


def stream_summary(per_stream: DataFrame, digits: int = 4) -> DataFrame:
    """Median and mean of the per-series R2, series won, series in all.

    The median is exact however many series there are, and is found at once.
    """
    return per_stream.agg(
        F.round(F.lit(exact_median(per_stream, "r2")).cast("double"), digits).alias("median_series_r2"),
        F.round(F.avg("r2"), digits).alias("mean_series_r2"),
        F.coalesce(F.sum(F.col("beat_naive").cast("long")), F.lit(0)).alias("streams_beat_naive"),
        F.count("*").alias("total_streams"),
    )


def naive_constant(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows with the last training value of their series and the step ahead (1, 2, ...)."""
    last = train.groupBy(*SERIES).agg(F.max_by(TARGET, DATE).alias("naive_constant"))
    step = F.row_number().over(Window.partitionBy(*SERIES).orderBy(DATE))
    return test.withColumn("step", step).join(last, SERIES)


def step_summary(
    df: DataFrame, pred: str, naive: str = "naive_constant", digits: int = 2
) -> DataFrame:
    """WAPE by step ahead for model and constant naive, the winner, and the edge in points."""
    sums = df.groupBy("step").agg(
        wape(F.col(TARGET), F.col(pred)).alias("model"),
        wape(F.col(TARGET), F.col(naive)).alias("naive"),
    )
    return sums.select(
        "step",
        F.round("model", digits).alias("model_wape"),
        F.round("naive", digits).alias("naive_wape"),
        F.when(F.col("model") < F.col("naive"), "model").otherwise("naive").alias("winner"),
        F.round(F.col("naive") - F.col("model"), digits).alias("edge"),
    )


def horizon_metrics(backtest: DataFrame, digits: int = 2) -> DataFrame:
    """One row: WAPE over the whole horizon for the recursive model and the constant naive."""
    sums = backtest.agg(
        wape(F.col(TARGET), F.col("recursive_pred")).alias("model"),
        wape(F.col(TARGET), F.col("naive_constant")).alias("naive"),
    ).select(
        F.round("model", digits).alias("multi_model_wape"),
        F.round("naive", digits).alias("multi_naive_wape"),
    )
    return sums.withColumn(
        "multi_improvement",
        F.round(F.col("multi_naive_wape") - F.col("multi_model_wape"), digits),
    )


def evaluate(scored: DataFrame, backtest: DataFrame, pred: str) -> tuple[DataFrame, DataFrame]:
    """(one-row metric bundle, per-series table)."""
    per_stream = per_stream_metrics(scored, pred)
    # One-row frames side by side: each further one is a single scalar subquery.
    bundle = pooled_metrics(scored, pred)
    for part in [stream_summary(per_stream), horizon_metrics(backtest)]:
        row = part.select(F.struct(*part.columns)).scalar()
        bundle = bundle.withColumn("_row", row).select(*bundle.columns, "_row.*")
    return bundle, per_stream


def stream_table(per_stream: DataFrame, platform: str | None = None) -> DataFrame:
    """The per-series table of one platform, or of all, as it is shown in reports."""
    verdict = F.when(F.col("beat_naive"), "Yes").otherwise("No")
    return (
        select_market(per_stream, platform=platform)
        .select(
            "stream",
            "r2",
            "model_wape",
            "naive_wape",
            "mae_m",
            "mean_sales_m",
            verdict.alias("beats_naive"),
        )
        .orderBy("stream")
    )


def select_market(df: DataFrame, region: str | None = None, platform: str | None = None) -> DataFrame:
    """Optional filters; None keeps everything."""
    if region is not None:
        df = df.filter(F.col("region") == region)
    if platform is not None:
        df = df.filter(F.col("platform") == platform)
    return df


def actual_vs_pred(
    df: DataFrame, pred: str, region: str | None = None, platform: str | None = None
) -> DataFrame:
    """Weekly totals of actual and predicted sales for the chosen market."""
    return (
        select_market(df, region, platform)
        .groupBy(DATE)
        .agg(F.sum(TARGET).alias("sales"), F.sum(pred).alias("y_pred"))
    )


def history_total(
    df: DataFrame, region: str | None = None, platform: str | None = None
) -> DataFrame:
    """Weekly totals of actual sales for the chosen market."""
    return select_market(df, region, platform).groupBy(DATE).agg(F.sum(TARGET).alias("sales"))
