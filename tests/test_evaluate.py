from datetime import timedelta

import pytest

from martlib.operators import evaluate as E

from conftest import monday

START = monday(2020, 7, 13)
SCHEMA = "week_date date, region string, platform string, sales double, naive_pred double, y_pred double"


@pytest.fixture
def scored(spark):
    rows = []
    for i, (a, n, p) in enumerate([(10, 8, 9), (12, 10, 12), (8, 12, 9)]):
        rows.append((START + timedelta(weeks=i), "ASIA", "Retail", float(a), float(n), float(p)))
    for i in range(3):  # constant series, naive is perfect
        rows.append((START + timedelta(weeks=i), "USA", "Shopify", 5.0, 5.0, 6.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_pooled(scored):
    row = E.pooled_metrics(scored, "y_pred").first()
    actual, pred = [10, 12, 8, 5, 5, 5], [9, 12, 9, 6, 6, 6]
    mean = sum(actual) / 6
    r2 = 1 - sum((a - p) ** 2 for a, p in zip(actual, pred)) / sum((a - mean) ** 2 for a in actual)
    assert row.pooled_r2 == pytest.approx(r2, abs=1e-4)
    assert row.model_wape == round(100 * 5 / 45, 2)
    assert row.naive_wape == round(100 * 8 / 45, 2)
    assert row.wape_improvement == round(100 * 3 / 45, 2)


def test_per_stream_and_summary(scored):
    per = E.per_stream_metrics(scored, "y_pred")
    asia, usa = sorted(per.collect(), key=lambda r: r.region)
    assert (asia.stream, asia.r2, asia.beat_naive) == ("ASIA (Retail)", 0.75, True)
    assert (asia.model_wape, asia.naive_wape) == (6.67, 26.67)
    assert (asia.mae_m, asia.mean_sales_m) == (0.667, 10.0)
    assert usa.r2 is None and usa.naive_wape == 0.0 and usa.beat_naive is False
    row = E.stream_summary(per).first()
    assert tuple(row) == (0.75, 0.75, 1, 2)
    table = E.stream_table(per, "Retail").collect()
    assert [(r.stream, r.beats_naive) for r in table] == [("ASIA (Retail)", "Yes")]


def test_all_zero_actuals_give_null(spark):
    df = spark.createDataFrame([(START, "A", "R", 0.0, 1.0, 1.0)], SCHEMA)
    row = E.per_stream_metrics(df, "y_pred").first()
    assert row.model_wape is None and row.r2 is None


def test_naive_constant_and_steps(spark):
    train = spark.createDataFrame(
        [(START + timedelta(weeks=i), "A", "R", float(i + 1)) for i in range(3)],
        "week_date date, region string, platform string, sales double",
    )
    test = spark.createDataFrame(
        [
            (START + timedelta(weeks=3), "A", "R", 4.0, 3.0),
            (START + timedelta(weeks=4), "A", "R", 6.0, 4.0),
        ],
        "week_date date, region string, platform string, sales double, naive_pred double",
    )
    stepped = E.naive_constant(train, test)
    assert sorted((r.step, r.naive_constant) for r in stepped.collect()) == [(1, 3.0), (2, 3.0)]
    rows = E.step_summary(stepped, "naive_pred").orderBy("step").collect()
    assert [(r.step, r.model_wape, r.naive_wape, r.winner, r.edge) for r in rows] == [
        (1, 25.0, 25.0, "naive", 0.0),
        (2, 33.33, 50.0, "model", 16.67),
    ]


def test_weekly_totals_and_optional_filters(scored):
    everything = E.actual_vs_pred(scored, "y_pred").orderBy("week_date").first()
    assert (everything.sales, everything.y_pred) == (15.0, 15.0)
    asia = E.actual_vs_pred(scored, "y_pred", region="ASIA").orderBy("week_date").first()
    assert (asia.sales, asia.y_pred) == (10.0, 9.0)
    assert E.history_total(scored, "ASIA", "Shopify").count() == 0


def test_evaluate_bundle(scored, plan_of):
    backtest = scored.withColumnsRenamed({"y_pred": "recursive_pred", "naive_pred": "naive_constant"})
    bundle, per = E.evaluate(scored, backtest, "y_pred")
    plan = plan_of(bundle)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    row = bundle.first()
    assert row.total_streams == per.count() == 2
    assert (row.multi_model_wape, row.multi_naive_wape) == (11.11, 17.78)
    assert row.multi_improvement == pytest.approx(6.67)
