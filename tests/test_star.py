from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlib import schemas as S
from martlib.operators import ids
from martlib.operators.star import (
    Star,
    build_star,
    check_constraints,
    mart,
    read_high_water,
    read_star,
    register_views,
    verify_counts,
    write_star,
)
from martlib.sources.raw import write_raw_table

ROWS = [
    ("31/8/20", " usa", "Shopify", "f1", "Guest", 3, "30.00"),
    ("24/8/20", "ASIA", "Retail", "C3", "New", 4, "10.00"),
    ("2018-03-26", "asia ", "Retail", None, "Existing", 0, "7.00"),
    ("never", "ASIA", "Retail", "C3", "New", 4, "10.00"),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("star")
    raw = spark.createDataFrame([(*r[:6], Decimal(r[6])) for r in ROWS], S.RAW)
    path = str(where / "star")
    return build_star(write_raw_table(raw, str(where / "raw")), path), path


def test_build(spark, built):
    star, path = built
    assert [tuple(r) for r in star.dim_region.orderBy("region_id").collect()] == [
        (1, "ASIA"),
        (2, "USA"),
    ]
    assert [r.segment_code for r in star.dim_segment.orderBy("segment_id").collect()] == [
        "C3",
        "F1",
        "unknown",
    ]
    rows = mart(star).orderBy("sales_id").collect()
    assert [(r.sales_id, r.region, r.calendar_year, r.week_number) for r in rows] == [
        (1, "ASIA", 2018, 14),
        (2, "ASIA", 2020, 35),
        (3, "USA", 2020, 36),
    ]
    assert [r.avg_transaction for r in rows] == [Decimal("0.00"), Decimal("2.50"), Decimal("10.00")]
    assert read_high_water(spark, path) == 3
    rejects = spark.read.parquet(f"{path}/rejects").collect()
    assert [(r.raw_week_date, r.reject_reason) for r in rejects] == [("never", "week_date")]
    counts = {r.table_name: r.row_count for r in verify_counts(star).collect()}
    assert counts == {
        "dim_region": 2,
        "dim_platform": 2,
        "dim_segment": 3,
        "fact_weekly_sales": 3,
        "clean_weekly_sales": 3,
    }
    assert all(r.violations == 0 for r in check_constraints(star).collect())


def test_iso_rule(star_of):
    star, _ = star_of(ROWS[2:3], week_rule="iso")
    assert star.fact.first().week_number == 13


def test_write_star_round_trip(spark, built, tmp_path):
    star, _ = built
    write_star(star, str(tmp_path / "copy"), 3)
    copy = read_star(spark, str(tmp_path / "copy"))
    assert sorted(copy.fact.collect()) == sorted(star.fact.collect())


def test_views(spark, built):
    star, _ = built
    register_views(star)
    sql = "SELECT sum(sales) FROM clean_weekly_sales WHERE region = 'ASIA'"
    assert spark.sql(sql).first()[0] == Decimal("17.00")


def test_year_filter_prunes_partitions(built, plan_of):
    star, _ = built
    plan = plan_of(star.fact.filter("calendar_year = 2020").agg(F.sum("sales")))
    assert "PartitionFilters: [isnotnull(calendar_year" in plan
    assert "ReadSchema: struct<sales:decimal(18,2)>" in plan


def test_ids_are_gapless_and_ordered_with_a_pile_of_copies(spark, tmp_path):
    """A third of all rows are copies of one row; ids stay 1..n in key order over many files."""
    spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id") % 100).alias("k")
    ).repartition(5).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    numbered, last, staged = ids.number_rows(ids.mark_ties(table), ["k"], "n", 10, partitions=8)
    assert last == 9010 and numbered.columns == ["n", "k"]
    rows = numbered.orderBy("n").collect()
    assert [r.n for r in rows] == list(range(11, 9011))
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    per_file = (
        spark.read.parquet(staged)
        .groupBy(F.col("_metadata.file_name"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    assert len(per_file) == 8
    assert max(r.n for r in per_file) < 2 * 9000 / 8  # the copies were spread


def test_constraint_violations_are_counted(spark, built):
    star, _ = built
    twice = star.fact.unionByName(star.fact.filter("sales_id = 1"))
    broken = twice.withColumn(
        "segment_id", F.when(F.col("sales_id") == 2, 99).otherwise(F.col("segment_id"))
    ).withColumn("customer_type", F.when(F.col("sales_id") != 3, F.col("customer_type")))
    doubled = star.dim_platform.unionByName(star.dim_platform.filter("platform_id = 1"))
    found = check_constraints(Star(star.dim_region, doubled, star.dim_segment, broken)).collect()
    bad = {(r.table_name, r.rule): r.violations for r in found if r.violations}
    assert bad == {
        ("fact_weekly_sales", "unique_sales_id"): 1,
        ("fact_weekly_sales", "not_null"): 1,
        ("fact_weekly_sales", "foreign_key_segment_id"): 1,
        ("dim_platform", "unique_platform_id"): 1,
        ("dim_platform", "unique_platform_name"): 1,
    }


def test_no_usable_row_gives_empty_tables(spark, star_of):
    star, path = star_of(ROWS[3:])
    assert [star.table(t).count() for t in ("dim_region", "dim_segment", "fact_weekly_sales")] == [0] * 3
    assert read_high_water(spark, path) == 0
    assert all(r.violations == 0 for r in check_constraints(star).collect())
    assert {r.row_count for r in verify_counts(star).collect()} == {0}


def test_a_large_order_is_kept(star_of):
    star, _ = star_of([("31/8/20", "ASIA", "Retail", "C3", "New", 1, "200000000.00")])
    row = star.fact.first()
    assert (str(row.sales), str(row.avg_transaction)) == ("200000000.00", "200000000.00")
