from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlib.operators import forecast as FC
from martlib.operators import model as M
from martlib.operators import panel as P
from martlib.storage import write_through

from conftest import monday
from test_panel import SCHEMA, START, series

LEVELS = {"region": ["ASIA", "USA"], "platform": ["Retail", "Shopify"]}
SPLIT = "2020-12-07"
SMALL = M.GbtParams(trees=4, depth=2)


@pytest.fixture(scope="module")
def panel(spark):
    rows = series("ASIA", "Retail", 56, 10) + series("USA", "Shopify", 56, 40)
    rows += series("USA", "Retail", 53, 5, skip=(20, 21))
    return write_through(spark.createDataFrame(rows, SCHEMA), "panel").cache()


@pytest.fixture(scope="module")
def features(panel):
    return write_through(P.engineer_features(panel), "features")


@pytest.fixture(scope="module")
def fitted(features):
    return M.fit_gbt(P.split(features, SPLIT)[0], SMALL)


def test_fit_is_deterministic_and_predictions_are_not_negative(features, fitted):
    train, test = P.split(features, SPLIT)
    again = M.fit_gbt(train, SMALL)

    def predictions(m):
        return sorted(tuple(r) for r in M.predict(m, test).select(*P.SERIES, P.DATE, "y_pred").collect())

    assert predictions(fitted) == predictions(again)
    shifted = test.withColumn(P.TARGET, F.col(P.TARGET) - 100)
    low = M.fit_gbt(train.withColumn(P.TARGET, -F.col(P.TARGET)), SMALL)
    assert {r.y_pred for r in M.predict(low, shifted).collect()} == {0.0}


def test_importance_lists_used_features_with_labels(spark, fitted):
    rows = M.feature_importance(fitted, spark, 6).collect()
    gains = [r.gain for r in rows]
    assert gains == sorted(gains, reverse=True) and min(gains) > 0
    assert sum(r.share for r in rows) == pytest.approx(1, abs=1e-3)
    labels = {r.feature: r.label for r in rows}
    for name, label in labels.items():
        if name.startswith("region_"):
            assert label == "Region: " + name.removeprefix("region_")
        else:
            assert label == M.LABELS.get(name, name)


def test_save_and_load(spark, fitted, features, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, path)
    M.save_model(spark, fitted, path)
    M.save_model(spark, fitted, path)
    loaded = M.load_model(spark, path)
    assert M.feature_columns(loaded) == P.encode_dummies(features, LEVELS)[1]
    row = features.limit(1)
    assert M.predict(loaded, row).first().y_pred == M.predict(fitted, row).first().y_pred


@pytest.mark.parametrize("weeks", [5, 6, 13, 30])
def test_expanding_folds(spark, weeks):
    dates = [START + timedelta(weeks=i) for i in range(weeks)]
    df = spark.createDataFrame([(d,) for d in dates for _ in range(2)], "week_date date")
    rows = M.expanding_folds(df, 5).orderBy("fold").collect()
    t = weeks // 6
    want = [
        (i, dates[weeks - (5 - i) * t], dates[weeks - (4 - i) * t - 1], t)
        for i in range(5)
        if t
    ]
    assert [tuple(r) for r in rows] == want


def test_tune_scores_prefixes_like_separate_fits(features):
    train = P.split(features, SPLIT)[0]
    best, scores = M.tune(train, {"trees": [2, 4], "depth": [1, 2]}, folds=2)
    rows = scores.collect()
    assert len(rows) == 4 and all(r.folds == 2 for r in rows)
    low = min(rows, key=lambda r: r.mean_mae)
    assert (best.trees, best.depth) == (low.trees, low.depth)

    errors = []
    for b in M.expanding_folds(train, 2).collect():
        past = train.filter(F.col(P.DATE) < F.lit(b.test_from))
        fold = train.filter(F.col(P.DATE).between(b.test_from, b.test_to))
        alone = M.fit_gbt(past, M.GbtParams(trees=2, depth=2))
        gap = F.avg(F.abs(F.col(P.TARGET) - F.col(M.RAW_PREDICTION)))
        errors.append(M.predict_raw(alone, fold).agg(gap).first()[0])
    scored = next(r for r in rows if (r.trees, r.depth) == (2, 2))
    assert scored.mean_mae == pytest.approx(np.mean(errors), rel=1e-9)


def test_tune_needs_enough_weeks(features):
    few = features.filter(F.col(P.DATE) >= F.lit(START + timedelta(weeks=54)))
    with pytest.raises(ValueError):
        M.tune(few, {"trees": [1]}, folds=5)


# ---- recursive forecast against a plain loop -----------------------------------------


def features_by_hand(history, d, transactions, region, platform, sample, short_lag):
    def lag(k):
        if len(history) >= k:
            return history[-k]
        return history[-1] if short_lag == "lag_1" else 0.0

    row = {f"lag_{k}": lag(k) for k in P.LAGS}
    for k in P.MEAN_WINDOWS:
        row[f"rolling_mean_{k}"] = float(np.mean(history[-k:] if len(history) >= k else history))
    for k in P.STD_WINDOWS:
        enough = len(history) >= k
        row[f"rolling_std_{k}"] = float(np.std(history[-k:], ddof=int(sample))) if enough else 0.0
    week = int(d.strftime("%W")) + 1
    row |= {
        "week_number": week,
        "month_number": d.month,
        "quarter": (d.month + 2) // 3,
        "calendar_year": d.year,
        "transactions": transactions,
        "is_packaging_week": int(week >= 25 and d.year == 2020),
        "region_USA": int(region == "USA"),
        "platform_Shopify": int(platform == "Shopify"),
    }
    return row


def score_by_hand(fitted, row):
    nodes, total = {n[:2]: n for n in fitted.nodes}, fitted.intercept
    for tree in range(fitted.trees):
        at = 0
        while nodes[tree, at][2] is not None:
            _, _, feature, _, is_category, threshold, *_ = nodes[tree, at]
            at = 2 * at + (1 if row[feature] < (0.5 if is_category else threshold) else 2)
        total += nodes[tree, at][-1]
    return max(total, 0.0)


@pytest.mark.parametrize("sample, short_lag", [(True, "zero"), (False, "lag_1")])
def test_forecast_matches_a_plain_loop(panel, fitted, sample, short_lag):
    recent = panel.filter(F.col(P.DATE) >= F.lit(START + timedelta(weeks=46)))  # under 12 rows
    made = FC.forecast(fitted, recent, 4, sample_std=sample, short_lag=short_lag, digits=9)
    got = {(r.region, r.platform, r.step): (r.week_date, r.forecast) for r in made.collect()}
    frame = recent.toPandas().sort_values(P.DATE)
    last = frame[P.DATE].max()
    want = {}
    for (region, platform), g in frame.groupby(P.SERIES):
        history, tx = list(g.sales), g.transactions.iloc[-1]
        for step in range(1, 5):
            d = last + timedelta(weeks=step)
            row = features_by_hand(history, d, tx, region, platform, sample, short_lag)
            history.append(score_by_hand(fitted, row))
            want[region, platform, step] = (d, history[-1])
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0]
        assert got[key][1] == pytest.approx(want[key][1], abs=1e-8)


@pytest.mark.parametrize("policy", ["last_value", "actual"])
def test_backtest_matches_a_plain_loop(features, fitted, policy):
    train, test = P.split(features, SPLIT)
    made = FC.backtest_recursive(fitted, train, test, transactions_policy=policy)
    got = {(r.region, r.platform, r.step): r for r in made.collect()}
    train, test = (df.toPandas().sort_values(P.DATE) for df in (train, test))
    seen = 0
    for (region, platform), g in test.groupby(P.SERIES):
        known = train[(train.region == region) & (train.platform == platform)]
        history = list(known.sales)
        for step, (_, week) in enumerate(g.iterrows(), 1):
            tx = week.transactions if policy == "actual" else known.transactions.iloc[-1]
            row = features_by_hand(history, week.week_date, tx, region, platform, True, "lag_1")
            history.append(score_by_hand(fitted, row))
            r = got[region, platform, step]
            assert r.recursive_pred == pytest.approx(history[-1], abs=1e-9)
            assert (r.week_date, r.sales) == (week.week_date, week.sales)
            assert r.naive_constant == known.sales.iloc[-1]
            seen += 1
    assert seen == len(got)
    lengths = test.groupby(P.SERIES).size()
    assert lengths.nunique() > 1  # series of different length stay apart


def test_steps_do_not_shuffle_and_long_horizons_are_cut(panel, fitted, plan_of, monkeypatch):
    short, longer = (FC.forecast(fitted, panel, h) for h in (1, 3))
    assert plan_of(short).count("Exchange") == plan_of(longer).count("Exchange")
    assert "Python" not in plan_of(longer)
    whole = sorted(tuple(r) for r in FC.forecast(fitted, panel, 5).collect())
    monkeypatch.setattr(FC, "STEPS_PER_PLAN", 2)
    assert sorted(tuple(r) for r in FC.forecast(fitted, panel, 5).collect()) == whole


def test_bad_options(panel, fitted):
    with pytest.raises(ValueError):
        FC.forecast(fitted, panel, 1, short_lag="maybe")
    with pytest.raises(ValueError):
        FC.backtest_recursive(fitted, panel, panel, transactions_policy="maybe")


def test_future_calendar_and_band(spark, panel):
    rows = FC.future_calendar(panel, 3).orderBy("step").collect()
    last = START + timedelta(weeks=55)
    assert [r.week_date for r in rows] == [last + timedelta(weeks=k) for k in (1, 2, 3)]
    assert [r.week_number for r in rows] == [int(r.week_date.strftime("%W")) + 1 for r in rows]

    forecasts = spark.createDataFrame(
        [
            (monday(2021, 2, 1), "A", "R", 1.0),
            (monday(2021, 2, 1), "B", "R", 2.0),
            (monday(2021, 2, 8), "A", "R", 5.0),
        ],
        "week_date date, region string, platform string, forecast double",
    )
    totals = FC.forecast_total(forecasts)
    assert sorted(r.forecast for r in totals.collect()) == [3.0, 5.0]
    assert FC.forecast_total(forecasts, region="B").count() == 1
    half = 0.5 * np.std([3.0, 5.0], ddof=1)
    bands = FC.forecast_band(totals).orderBy("forecast").collect()
    assert [r.lower for r in bands] == pytest.approx([3 - half, 5 - half])
    assert [r.upper for r in bands] == pytest.approx([3 + half, 5 + half])


def test_many_regions_train_and_forecast(spark):
    rows = [r for i in range(1500) for r in series(f"R{i:04d}", "Retail", 14, i % 90)]
    many = write_through(spark.createDataFrame(rows, SCHEMA), "many")
    made = write_through(P.engineer_features(many), "many-features")
    fitted = M.fit_gbt(made, M.GbtParams(trees=2, depth=2))
    assert len(M.feature_columns(fitted)) == len(P.BASE_FEATURES) + 1499
    made = FC.forecast(fitted, many, 2)
    assert made.count() == 3000 and made.filter("forecast IS NULL OR forecast < 0").count() == 0


def test_a_region_unseen_in_training_is_scored(features, fitted):
    unseen = features.limit(3).withColumn("region", F.lit("ATLANTIS"))
    assert all(r.y_pred >= 0 for r in M.predict(fitted, unseen).collect())
