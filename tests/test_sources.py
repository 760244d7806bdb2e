import pytest

from martlib import schemas as S
from martlib.sources import raw as R
from martlib.sources.query import run_query

ROWS = [
    ("31/8/20", "ASIA", "Retail", "C3", "New", 120631, "3656163.00"),
    ("31/8/20", "usa ", "Shopify", 'F"1', "Guest", 3, "0.50"),
]


def test_csv_round_trip_keeps_blanks_and_quotes(spark, raw_frame, tmp_path):
    df = raw_frame(ROWS)
    R.write_csv(df, str(tmp_path / "csv"))
    back = R.read_raw_csv(spark, str(tmp_path / "csv"))
    assert back.schema == S.RAW
    assert sorted(back.collect()) == sorted(df.collect())


def test_csv_bad_number_reads_as_null(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "week_date,region,platform,segment,customer_type,transactions,sales\n"
        "31/8/20,ASIA,Retail,C3,New,many,1.5\n"
    )
    row = R.read_raw_csv(spark, str(path)).first()
    assert row.transactions is None and str(row.sales) == "1.50"


DUMP = """CREATE TABLE weekly_sales (x int);
INSERT INTO weekly_sales VALUES
('31/8/20', 'asia', 'Retail', 'C3', 'New', '120631', '3656163'),
  ('31/8/20', 'USA', 'Shopify', 'F1', 'Guest', '3', '0.5'), ('24/8/20','USA','Retail','null','New','1','2');
('31/8/20', 'USA', 'Kiosk', 'F1', 'Guest', '3', '0.5'),
-- ('31/8/20', 'USA', 'Retail', 'F1', 'Guest', '3', '0.5')
('31/8/20', 'USA', 'Retail', 'F1', '', '3', '0.5'),
"""


def test_sqldump(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    df = R.read_raw_sqldump(spark, str(path))
    assert df.schema == S.RAW
    got = sorted((r.week_date, r.region, r.platform, r.transactions) for r in df.collect())
    assert got == [
        ("24/8/20", "USA", "Retail", 1),
        ("31/8/20", "ASIA", "Retail", 120631),
        ("31/8/20", "USA", "Shopify", 3),
    ]


def test_resolve_raw(spark, tmp_path):
    csv, dump = str(tmp_path / "raw.csv"), tmp_path / "dump.sql"
    with pytest.raises(FileNotFoundError):
        R.resolve_raw(spark, csv, str(dump))
    dump.write_text(DUMP)
    assert R.resolve_raw(spark, csv, str(dump)).count() == 3
    dump.write_text("")
    assert R.resolve_raw(spark, csv, str(dump)).count() == 3  # the kept CSV now wins


def test_raw_table_is_replaced(spark, raw_frame, tmp_path):
    path = str(tmp_path / "raw")
    R.write_raw_table(raw_frame(ROWS), path)
    table = R.write_raw_table(raw_frame(ROWS[:1]), path)
    assert table.count() == 1 and table.schema == S.RAW


@pytest.mark.parametrize(
    "sql, params",
    [
        ("SELECT id FROM nums WHERE id = %s AND '%s' = '%s'", [3]),
        ("SELECT id FROM nums WHERE id = ?", (3,)),
        ("SELECT id FROM nums WHERE id = :n", {"n": 3}),
        ("SELECT id FROM nums WHERE id = 3", None),
    ],
)
def test_run_query(spark, sql, params):
    spark.range(5).createOrReplaceTempView("nums")
    assert [r.id for r in run_query(spark, sql, params).collect()] == [3]


def test_run_query_binds_values_not_text(spark):
    spark.createDataFrame([("a",)], "s string").createOrReplaceTempView("texts")
    assert run_query(spark, "SELECT * FROM texts WHERE s = %s", ["' OR '1'='1"]).count() == 0


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "sales,region,note,Platform,customer_type,transactions,segment,week_date\n"
        "3656163.00,\tASIA\t,x,Retail,New,120631.0,\tC3, 31/8/20\n"
        "1.00,ASIA,x,Retail,New,1.5,C3,31/8/20\n"
    )
    one, two = R.read_raw_csv(spark, str(path)).collect()
    assert (one.region, one.platform, one.transactions, str(one.sales)) == ("\tASIA\t", "Retail", 120631, "3656163.00")
    assert two.transactions is None
    from martlib.operators.clean import clean_weekly_sales

    clean = clean_weekly_sales(R.read_raw_csv(spark, str(path))).first()
    assert (clean.region, clean.segment_code, clean.demographic, str(clean.week_date)) == ("ASIA", "C3", "Couples", "2020-08-31")


def test_csv_without_a_column_is_an_error(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("week_date,region\n31/8/20,ASIA\n")
    with pytest.raises(ValueError, match="platform"):
        R.read_raw_csv(spark, str(path))


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT \"a%s\" AS a, %s AS b", ("a%s", 7)),
        ("SELECT 'it''s %s' AS a, %s AS b -- %s", ("it's %s", 7)),
        ("SELECT 'x' AS `a%s`, /* %s */ %s AS b", ("x", 7)),
        ("SELECT 'q\\'%s' AS a, %s AS b", ("q'%s", 7)),
    ],
)
def test_run_query_leaves_quotes_and_comments_alone(spark, sql, expected):
    assert tuple(run_query(spark, sql, [7]).first()) == expected
