from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlib.operators import panel as P

from conftest import monday

START = monday(2020, 1, 6)
SCHEMA = (
    "week_date date, region string, platform string, week_number int, month_number int,"
    " calendar_year int, sales double, transactions double"
)


def series(region, platform, weeks, level, skip=()):
    rng = np.random.default_rng(len(region) + weeks)
    rows = []
    for i in range(weeks):
        if i in skip:
            continue
        d = START + timedelta(weeks=i)
        value = float(level + rng.normal())
        rows.append((d, region, platform, int(d.strftime("%W")) + 1, d.month, d.year, value, value * 2))
    return rows


@pytest.fixture
def two_series(spark):
    rows = series("ASIA", "Retail", 30, 10, skip=(7,)) + series("USA", "Shopify", 30, 1000)
    rows += series("USA", "Retail", 5, 50)
    return spark.createDataFrame(rows, SCHEMA)


def test_features_match_a_per_series_computation(two_series):
    made = P.engineer_features(two_series).toPandas()
    frames = []
    for _, g in two_series.toPandas().sort_values("week_date").groupby(["region", "platform"]):
        g = g.copy()
        for k in P.LAGS:
            g[f"lag_{k}"] = g.sales.shift(k)
        past = g.sales.shift(1)
        for k, least in P.MEAN_WINDOWS.items():
            g[f"rolling_mean_{k}"] = past.rolling(k, min_periods=least).mean()
        for k, least in P.STD_WINDOWS.items():
            g[f"rolling_std_{k}"] = past.rolling(k, min_periods=least).std()
        frames.append(g)
    want = pd.concat(frames).dropna()
    keys = ["region", "platform", "week_date"]
    made, want = made.sort_values(keys), want.sort_values(keys)
    assert len(made) == len(want) == (29 - 12) + (30 - 12)
    for column in want.columns:
        if column not in keys:
            np.testing.assert_allclose(made[column], want[column], rtol=1e-9)
    assert (made.naive_pred == made.lag_1).all()


def test_short_series_is_dropped(two_series):
    kept = P.engineer_features(two_series).select(*P.SERIES).distinct().collect()
    assert {tuple(r) for r in kept} == {("ASIA", "Retail"), ("USA", "Shopify")}


def test_warm_up_rolling_respects_least_rows(two_series):
    made = P.add_rolling_std(P.add_rolling_mean(two_series)).filter("platform = 'Shopify'")
    rows = made.orderBy("week_date").collect()
    assert [r.rolling_mean_4 is None for r in rows[:4]] == [True, True, False, False]
    assert [r.rolling_mean_8 is None for r in rows[:5]] == [True] * 4 + [False]
    assert [r.rolling_std_4 is None for r in rows[:4]] == [True, True, False, False]


def test_no_feature_uses_its_own_week_or_later(spark, two_series):
    """Changing one week's sales changes no feature at or before that week."""
    cut = START + timedelta(weeks=20)
    changed = two_series.withColumn(
        "sales", F.when(F.col("week_date") >= F.lit(cut), F.col("sales") * 9).otherwise(F.col("sales"))
    )
    columns = [c for c in P.BASE_FEATURES if c.startswith(("lag", "rolling"))]

    def until(df):
        rows = P.engineer_features(df).filter(F.col("week_date") <= F.lit(cut))
        return sorted(tuple(r) for r in rows.select(*P.SERIES, "week_date", *columns).collect())

    assert until(two_series) == until(changed)


def test_all_features_share_one_shuffle_and_sort(two_series, plan_of):
    plan = plan_of(P.engineer_features(two_series))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "Python" not in plan


def test_intervention_flag_is_for_one_year_only(spark):
    df = spark.createDataFrame([(24, 2020), (25, 2020), (25, 2021)], "w int, y int")
    flags = df.select(P.intervention_flag(F.col("w"), F.col("y"), 25, 2020)).collect()
    assert [r[0] for r in flags] == [0, 1, 0]


def test_dummies_drop_the_first_level(two_series):
    levels = {"region": ["USA", "ASIA", "EUROPE"], "platform": ["Retail", "Shopify"]}
    made, columns = P.encode_dummies(two_series, levels)
    assert columns[len(P.BASE_FEATURES) :] == ["region_EUROPE", "region_USA", "platform_Shopify"]
    row = made.filter("region = 'USA' AND platform = 'Shopify'").first()
    assert (row.region_EUROPE, row.region_USA, row.platform_Shopify) == (0, 1, 1)


def test_too_many_levels_are_an_error(spark):
    dim = spark.range(P.MAX_LEVELS).selectExpr("CAST(id AS STRING) AS region_name")
    assert P._levels(dim.union(dim), "region_name") == sorted(map(str, range(P.MAX_LEVELS)))
    with pytest.raises(ValueError, match="region_name"):
        P._levels(dim.union(spark.sql("SELECT 'x'")), "region_name")


def test_split_and_profile(two_series):
    train, test = P.split(two_series, "2020-05-04")
    assert train.count() + test.count() == two_series.count()
    assert test.agg(F.min("week_date")).first()[0] == monday(2020, 5, 4)
    row = P.panel_profile(two_series).first()
    assert (row.row_count, row.series_count, row.week_count) == (64, 3, 30)
    assert (row.first_week, row.last_week) == (START, START + timedelta(weeks=29))


def test_densify_fills_the_gap_with_zero(two_series):
    full = P.densify(two_series)
    assert full.count() == 30 + 30 + 5
    gap = full.filter((F.col("region") == "ASIA") & (F.col("sales") == 0)).collect()
    assert [r.week_date for r in gap] == [START + timedelta(weeks=7)]
    assert full.select(two_series.columns).schema.names == two_series.schema.names
