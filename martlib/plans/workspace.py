"""Tables derived once per application and input folder, then shared by all queries.

The ETL runs once and BI queries read its output, as in any warehouse: raw weekly
sales, the star schema and the panel features are written to the shared folder on
first use. The key holds the application id, so nothing outlives its session.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from martlib.operators import panel as P
from martlib.operators.forecast import backtest_recursive, forecast
from martlib.operators.model import GbtParams, fit_gbt, predict
from martlib.operators.star import Star, build_star, read_star
from martlib.sources.adapter import weekly_sales_from_orders
from martlib.sources.raw import write_raw_table
from martlib.storage import new_path, write_through

# Fixed values for the given tables (FIXTURES.md).
SPLIT_DATE = "2001-06-11"
INTERVENTION_YEAR = 1998
INTERVENTION_WEEK = 25


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        raw = weekly_sales_from_orders(self.spark, self.sf_dir)
        return write_raw_table(raw, new_path(self.spark, "weekly-sales"))

    @cached_property
    def star_path(self) -> str:
        path = new_path(self.spark, "star")
        build_star(self.raw, path)
        return path

    @cached_property
    def star(self) -> Star:
        return read_star(self.spark, self.star_path)

    @cached_property
    def panel(self) -> DataFrame:
        return write_through(P.panel_weekly(self.star), "panel")

    @cached_property
    def features(self) -> DataFrame:
        made = P.engineer_features(self.panel, INTERVENTION_YEAR, INTERVENTION_WEEK)
        return write_through(made, "features")

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        return P.split(self.features, SPLIT_DATE)

    @cached_property
    def model(self):
        return fit_gbt(self.split[0], GbtParams())

    @cached_property
    def scored(self) -> DataFrame:
        """The test rows with predictions as a table: reports read them several times."""
        return write_through(predict(self.model, self.split[1]), "scored")

    @cached_property
    def backtest(self) -> DataFrame:
        """The recursive backtest as a table, for the reports made from it."""
        return write_through(self.run_backtest(), "backtest")

    @cached_property
    def forecasts(self) -> DataFrame:
        """The 12-week forecast as a table, for the reports made from it."""
        return write_through(self.run_forecast(), "forecasts")

    def run_backtest(self) -> DataFrame:
        return backtest_recursive(
            self.model, *self.split, in_year=INTERVENTION_YEAR, from_week=INTERVENTION_WEEK
        )

    def run_forecast(self) -> DataFrame:
        return forecast(self.model, self.features, 12, INTERVENTION_YEAR, INTERVENTION_WEEK)


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
