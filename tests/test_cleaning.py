import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlib.functions import cleaning as C
from martlib.operators.clean import CLEAN_COLUMNS, clean_weekly_sales, split_rejects


@pytest.mark.parametrize(
    "text, expected",
    [
        ("31/8/20", date(2020, 8, 31)),
        ("2020-08-31", date(2020, 8, 31)),
        ("2020-8-3", date(2020, 8, 3)),
        ("31/08/2020", date(2020, 8, 31)),
        (" 5/1/98 ", date(1998, 1, 5)),
        ("7/1/69", date(1969, 1, 7)),
        ("7/1/68", date(2068, 1, 7)),
        ("29/2/00", date(2000, 2, 29)),
        ("29/2/99", None),
        ("31/02/20", None),
        ("99/99/20", None),
        ("bad", None),
        ("", None),
        (None, None),
        ("31/8/200", None),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_week_date(F.col("t"))).first()[0] == expected


def by_strptime(text):
    for pattern in ["%d/%m/%y", "%Y-%m-%d", "%d/%m/%Y"]:
        try:
            return datetime.strptime(text.strip(), pattern).date()
        except ValueError:
            pass
    return None


def test_random_dates_match_strptime(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(4000):
        d, m = rng.randint(0, 33), rng.randint(0, 13)
        y4, y2 = rng.randint(1900, 2100), rng.randint(0, 99)
        texts += [
            f"{d}/{m}/{y2:02d}",
            f"{d:02d}/{m:02d}/{y2:02d}",
            f"{y4}-{m}-{d}",
            f"{y4}-{m:02d}-{d:02d}",
            f"{d:02d}/{m:02d}/{y4}",
            f" {d}/{m}/{y4} ",
        ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, d in df.select("t", C.parse_week_date(F.col("t"))).collect():
        assert d == by_strptime(t), t


def test_week_numbers_match_the_calendar(spark):
    days = [date(2017, 12, 25) + timedelta(days=i) for i in range(3 * 366 + 20)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d",
        C.week_number(F.col("d")).alias("w1"),
        C.week_number(F.col("d"), "iso").alias("iso"),
    )
    for d, w1, iso in df.collect():
        assert w1 == int(d.strftime("%W")) + 1
        assert iso == d.isocalendar()[1]
    mondays = [r for r in df.collect() if r.d.weekday() == 0]
    assert all(r.w1 != r.iso for r in mondays if r.d.year == 2018)
    assert all(r.w1 == r.iso for r in mondays if r.d.year == 2020)


def test_unknown_week_rule():
    with pytest.raises(ValueError):
        C.week_number(None, "sunday")


@pytest.mark.parametrize(
    "text, code, age, demo",
    [
        ("c1", "C1", "Young Adults", "Couples"),
        (" F2 ", "F2", "Middle Aged", "Families"),
        ("C3", "C3", "Retirees", "Couples"),
        ("F4", "F4", "Retirees", "Families"),
        ("X9", "X9", "unknown", "unknown"),
        ("null", "unknown", "unknown", "unknown"),
        ("NaN", "unknown", "unknown", "unknown"),
        ("None", "unknown", "unknown", "unknown"),
        ("  ", "unknown", "unknown", "unknown"),
        (None, "unknown", "unknown", "unknown"),
    ],
)
def test_segments(spark, text, code, age, demo):
    df = spark.createDataFrame([(text,)], "t string").select(C.segment_code(F.col("t")).alias("c"))
    row = df.select("c", C.age_band(F.col("c")), C.demographic(F.col("c"))).first()
    assert tuple(row) == (code, age, demo)


@pytest.mark.parametrize(
    "sales, tx, expected",
    [
        ("10.00", 0, "0.00"),
        ("10.00", -1, "0.00"),
        ("2.01", 2, "1.01"),
        ("10.05", 2, "5.03"),
        ("1.00", 3, "0.33"),
        ("999999999999.99", 1, "999999999999.99"),
    ],
)
def test_avg_transaction(spark, sales, tx, expected):
    df = spark.createDataFrame([(Decimal(sales), tx)], "s decimal(14,2), t long")
    got = df.select(C.avg_transaction(F.col("s"), F.col("t"))).first()[0]
    assert got == (None if expected is None else Decimal(expected))


def test_rejects_keep_the_reason_and_the_text(raw_frame):
    good = ("31/8/20", " asia", "Retail ", "c3", " New", 2, "10.05")
    raw = raw_frame([good, ("soon", *good[1:]), (good[0], None, *good[2:])])
    accepted, rejected = split_rejects(clean_weekly_sales(raw))
    row = accepted.collect()
    assert accepted.columns == CLEAN_COLUMNS and len(row) == 1
    assert (row[0].region, row[0].platform, row[0].customer_type) == ("ASIA", "Retail", "New")
    reasons = {(r.reject_reason, r.raw_week_date) for r in rejected.collect()}
    assert reasons == {("week_date", "soon"), ("region", "31/8/20")}


def test_cleaning_is_one_projection_without_python(raw_frame, plan_of):
    plan = plan_of(clean_weekly_sales(raw_frame([("31/8/20", "a", "b", "c", "d", 1, "1")])))
    assert "Exchange" not in plan and "Python" not in plan
