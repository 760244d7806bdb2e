from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlib.operators import bi, impact, quality
from martlib.operators.star import Star
from martlib.plans import catalogue

from conftest import monday

ROWS = [
    ("2019-03-25", "ASIA", "Retail", "C1", "New", 2, "100.00"),
    ("2019-04-29", "ASIA", "Shopify", "F2", "New", 1, "50.00"),
    ("2019-04-29", "USA", "Retail", None, "Guest", 3, "150.00"),
    ("2020-03-30", "ASIA", "Retail", "C1", "New", 4, "300.00"),
    ("2020-06-15", "USA", "Retail", "F3", "Existing", 5, "80.00"),
    ("2020-06-08", "USA", "Shopify", "C2", "Existing", 2, "20.00"),
    ("2020-06-08", "ASIA", "Retail", "C2", "Existing", 2, "60.00"),
]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    from martlib import schemas as S
    from martlib.operators.star import build_star
    from martlib.sources.raw import write_raw_table

    where = tmp_path_factory.mktemp("bi")
    raw = spark.createDataFrame([(*r[:6], Decimal(r[6])) for r in ROWS], S.RAW)
    return build_star(write_raw_table(raw, str(where / "raw")), str(where / "star"))


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_rollup_joins_only_named_dimensions(star, plan_of):
    df = bi.rollup_sum(star, ["region_name"], ["sales", "records"])
    plan = plan_of(df)  # before it runs: afterwards the text also holds the final plan
    assert as_dict(df, "region_name", "sales") == {"ASIA": 510, "USA": 250}
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert "Python" not in plan
    assert "ReadSchema: struct<region_id:int,sales:decimal(18,2)>" in plan
    # the fact is aggregated below the join
    assert plan.index("BroadcastHashJoin") < plan.rindex("HashAggregate")


def test_equal_sums_rank_and_dense_rank(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 5), (1, "c", 3), (2, "a", 1)], "y int, k string, v long"
    )
    top = bi.rank_top(df, "v", ["y"], "r").collect()
    assert sorted((r.y, r.k, r.r) for r in top) == [(1, "a", 1), (1, "b", 1), (2, "a", 1)]
    dense = bi.dense_ranked(df, "v", "r").collect()
    assert sorted((r.v, r.r) for r in dense) == [(1, 3), (3, 2), (5, 1), (5, 1)]
    first = bi.top_k(df, "v", "k", 1).collect()
    assert [(r.k, r.v) for r in first] == [("a", 5)]


def test_growth_is_null_in_the_first_year_and_after_zero(spark):
    df = spark.createDataFrame(
        [("a", 1, 0), ("a", 2, 10), ("a", 3, 15), ("b", 1, 4)], "k string, y int, v long"
    )
    made = bi.growth(df, "v", ["k"], ["y"], "p", "g").orderBy("k", "y").collect()
    assert [(r.p, r.g) for r in made] == [(None, None), (0, None), (10, 50.0), (None, None)]


def test_shares_sum_to_one_hundred(star):
    sums = bi.rollup_sum(star, ["region_name", "platform_name"])
    within = bi.share_of(sums, "sales", ["region_name"], "p", 6)
    per_region = within.groupBy("region_name").agg(F.sum("p").alias("s"))
    assert list(as_dict(per_region, "region_name", "s").values()) == pytest.approx([100, 100])
    overall = bi.share_of(sums, "sales", [], "p", 6)
    assert overall.agg(F.sum("p")).first()[0] == pytest.approx(100)


def test_running_total_ends_at_the_yearly_sum(star):
    monthly = bi.rollup_sum(star, ["calendar_year", "month_number"])
    run = bi.running_total(monthly, "sales", ["calendar_year"], "month_number", "t")
    last = run.groupBy("calendar_year").agg(F.max_by("t", "month_number").alias("t"))
    assert as_dict(last, "calendar_year", "t") == {2019: 300, 2020: 460}


def test_rolling_average_uses_rows(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(1, 7)], "k string, d int, v long")
    made = bi.rolling_avg(df, "v", ["k"], "d", 4, "m").orderBy("d").collect()
    assert [r.m for r in made] == [1.0, 1.5, 2.0, 2.5, 3.5, 4.5]


def test_zero_transactions_give_null_ratio(spark):
    df = spark.createDataFrame([(Decimal("5.00"), 0)], "s decimal(14,2), t long")
    assert bi.ratio_of_sums(df, "s", "t", "r").first().r is None


def test_unmatched_segment_is_identified_and_lost_by_inner_joins(star):
    orphan = star.fact.withColumn(
        "segment_id", F.when(F.col("sales") == 150, 99).otherwise(F.col("segment_id"))
    )
    broken = Star(star.dim_region, star.dim_platform, star.dim_segment, orphan)
    sums = bi.rollup_sum(broken, ["platform_name", "segment_code"], ["records", "sales"], how="left")
    assert sums.filter("segment_code IS NULL").first().sales == 150
    inner = bi.rollup_sum(broken, ["segment_code"])
    assert inner.agg(F.sum("sales")).first()[0] == 760 - 150


def test_latest_rows_ignore_rows_without_a_dimension(star):
    rows = bi.latest_rows(star, 3).collect()
    assert [r.sales_id for r in rows] == [7, 6, 5]
    orphan = star.fact.withColumn(
        "region_id", F.when(F.col("sales_id") == 7, 99).otherwise(F.col("region_id"))
    )
    broken = Star(star.dim_region, star.dim_platform, star.dim_segment, orphan)
    assert [r.sales_id for r in bi.latest_rows(broken, 3).collect()] == [6, 5, 4]
    assert bi.latest_rows(star, 99).count() == 7
    empty = Star(star.dim_region, star.dim_platform, star.dim_segment, star.fact.limit(0))
    assert bi.latest_rows(empty).count() == 0


def test_kpis(star):
    row = bi.kpi_summary(star).first()
    assert (row.total_sales, row.total_transactions, row.total_regions) == (760, 19, 2)
    assert row.avg_transaction == Decimal("40.00")


def test_missing_weeks_and_weekdays(star):
    assert [r.day_of_week for r in quality.week_start_days(star).collect()] == ["Monday"]
    missing = {r.missing_week_number for r in quality.missing_weeks(star).collect()}
    present = {r.week_number for r in star.fact.collect()}
    assert missing == set(range(1, 53)) - present


def test_avg_of_avgs_differs_from_the_ratio(star):
    rows = quality.avg_of_avgs_vs_ratio(star).filter("calendar_year = 2020 AND platform = 'Retail'")
    row = rows.first()
    # row averages 75, 16, 30; sums 440 / 11
    assert (row.incorrect_avg_of_avgs, row.correct_avg_transaction) == (
        Decimal("40.33"),
        Decimal("40.00"),
    )


def test_impact_long_form(star):
    made = impact.period_impact(star, monday(2020, 6, 15), 4, 2020).collect()
    got = {r.period: (r.total_sales, r.sales_change, r.pct_change) for r in made}
    assert got == {"before": (80, None, None), "after": (80, 0, 0.0)}


def test_impact_before_plus_after_is_the_window_total(star):
    made = impact.period_impact(star, monday(2020, 6, 15), 12, by=["calendar_year"])
    total = made.groupBy("calendar_year").agg(F.sum("total_sales").alias("s"))
    window = star.fact.filter("week_number BETWEEN 13 AND 36").groupBy("calendar_year")
    assert as_dict(total, "calendar_year", "s") == as_dict(
        window.agg(F.sum("sales").alias("s")), "calendar_year", "s"
    )


def test_impact_wide_form_with_one_side_only(star):
    made = impact.period_impact_by(star, monday(2020, 6, 15), 4, 2020, "region_name").collect()
    got = {r.region_name: (r.before_sales, r.after_sales, r.pct_change) for r in made}
    assert got == {"ASIA": (60, None, None), "USA": (20, 80, 300.0)}


def test_impact_without_the_anchor_is_empty(star):
    assert impact.period_impact(star, monday(2020, 7, 20), 4, 2020).count() == 0
    assert impact.period_impact_by(star, monday(2020, 7, 20), 4, 2020, "age_band").count() == 0


def test_impact_filters_before_aggregating(star, plan_of):
    plan = plan_of(impact.period_impact(star, monday(2020, 6, 15), 4, 2020))
    assert "PartitionFilters: [isnotnull(calendar_year" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_fixed_windows(star):
    made = impact.fixed_window_impact(star, 2020, (21, 24), (25, 28)).collect()
    got = {r.period: (r.total_sales, r.total_transactions, r.avg_transaction) for r in made}
    assert got == {
        "Before Change (Weeks 21\u201324)": (80, 4, Decimal("20.00")),
        "After Change (Weeks 25\u201328)": (80, 5, Decimal("16.00")),
    }
    kpis = impact.fixed_window_kpis(star, 2020, (21, 24), (25, 28)).first()
    assert tuple(kpis) == (80, 80, 0, 0.0)


def test_catalogue_keys_cover_the_blueprint():
    from martlib.plans.oracle import ORACLE

    assert set(ORACLE) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) >= 80


def test_fixed_windows_with_a_gap_between_them(star):
    made = impact.fixed_window_impact(star, 2020, (20, 21), (27, 28)).collect()
    kpis = impact.fixed_window_kpis(star, 2020, (20, 21), (27, 28)).first()
    got = {r.period.split()[0]: r.total_sales for r in made}
    assert (got.get("Before"), got.get("After")) == (kpis.before_sales, kpis.after_sales)
