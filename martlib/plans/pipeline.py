"""The training pipeline: panel, features, split, tuning, final fit, evaluation, saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from martlib.operators import evaluate, forecast, model, panel
from martlib.operators.star import Star
from martlib.storage import path_exists, write_through

# The defaults of the original study.
SPLIT_DATE = "2020-07-13"
INTERVENTION_YEAR = 2020
INTERVENTION_WEEK = 25


@dataclass(frozen=True)
class Prepared:
    """Features as a written table."""

    features: DataFrame

    def split(self, date: str = SPLIT_DATE) -> tuple[DataFrame, DataFrame]:
        return panel.split(self.features, date)


@dataclass(frozen=True)
class Trained:
    model: model.TreeModel
    params: model.GbtParams
    scores: DataFrame | None
    metrics: DataFrame
    per_stream: DataFrame
    steps: DataFrame
    importance: DataFrame


def prepare(
    star: Star, in_year: int = INTERVENTION_YEAR, from_week: int = INTERVENTION_WEEK
) -> Prepared:
    made = panel.engineer_features(panel.panel_weekly(star), in_year, from_week)
    return Prepared(write_through(made, "features"))


def train_pipeline(
    star: Star,
    model_path: str,
    split_date: str = SPLIT_DATE,
    in_year: int = INTERVENTION_YEAR,
    from_week: int = INTERVENTION_WEEK,
    grid: dict | None = model.GRID,
    folds: int = 5,
    transactions_policy: str = "last_value",
) -> Trained:
    """Tune on time-ordered folds (``grid=None`` skips it), refit on all training rows,
    evaluate one step ahead and recursively, and save the model."""
    spark = star.fact.sparkSession
    prepared = prepare(star, in_year, from_week)
    train, test = prepared.split(split_date)
    params, scores = model.GbtParams(), None
    if grid is not None:
        params, scores = model.tune(train, grid, folds)
    fitted = model.fit_gbt(train, params)
    model.save_model(spark, fitted, model_path)

    scored = write_through(model.predict(fitted, test), "scored")
    backtest = write_through(
        forecast.backtest_recursive(fitted, train, test, in_year, from_week, transactions_policy),
        "backtest",
    )
    metrics, per_stream = evaluate.evaluate(scored, backtest, model.PREDICTION)
    return Trained(
        model=fitted,
        params=params,
        scores=scores,
        metrics=metrics,
        per_stream=per_stream,
        steps=evaluate.step_summary(backtest, "recursive_pred"),
        importance=model.feature_importance(fitted, spark),
    )


def load_or_fit(spark: SparkSession, model_path: str, train: DataFrame) -> model.TreeModel:
    """The saved model if there is one, else a fit with default parameters."""
    if path_exists(spark, model_path):
        return model.load_model(spark, model_path)
    return model.fit_gbt(train)
