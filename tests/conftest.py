import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martlib import schemas as S
from martlib.operators.star import build_star
from martlib.sources.raw import write_raw_table


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw_frame(spark):
    """Raw rows from tuples; sales as text."""

    def make(rows):
        return spark.createDataFrame([(*r[:6], Decimal(r[6])) for r in rows], S.RAW)

    return make


@pytest.fixture
def star_of(spark, raw_frame, tmp_path):
    """A stored star built from raw tuples: (star, path)."""
    count = iter(range(1000))

    def make(rows, **kwargs):
        n = next(count)
        raw = write_raw_table(raw_frame(rows), str(tmp_path / f"raw{n}"))
        path = str(tmp_path / f"star{n}")
        return build_star(raw, path, **kwargs), path

    return make


@pytest.fixture
def plan_of():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


def monday(year, month, day):
    d = date(year, month, day)
    assert d.weekday() == 0
    return d
