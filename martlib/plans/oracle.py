"""Independent SQL for each query, straight from the given tables, for DuckDB.

It shares nothing with the Spark side: the week number comes from strftime, averages
are half-up integer arithmetic on cents, and no star tables are read.
"""

from __future__ import annotations

PRELUDE = """
WITH RECURSIVE weekly AS (
    SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_date,
           upper(r_name) AS region,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Shopify' ELSE 'Retail' END
               AS platform,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
                    THEN 'C' || CAST(1 + c_custkey % 4 AS VARCHAR)
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')
                    THEN 'F' || CAST(1 + c_custkey % 4 AS VARCHAR)
                ELSE 'unknown' END AS segment,
           CASE o_orderstatus WHEN 'F' THEN 'Existing' WHEN 'O' THEN 'New' ELSE 'Guest' END
               AS customer_type,
           CAST(count(*) AS BIGINT) AS transactions,
           CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) * 100 AS BIGINT) AS cents
    FROM orders
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3, 4, 5
),
clean AS (
    SELECT row_number() OVER (
               ORDER BY week_date, region, platform, segment, customer_type) AS sales_id,
           *,
           CAST(strftime(week_date, '%W') AS INTEGER) + 1 AS week_number,
           CAST(month(week_date) AS INTEGER) AS month_number,
           CAST(year(week_date) AS INTEGER) AS calendar_year,
           CASE WHEN segment = 'unknown' THEN 'unknown'
                WHEN segment LIKE '%1' THEN 'Young Adults'
                WHEN segment LIKE '%2' THEN 'Middle Aged'
                ELSE 'Retirees' END AS age_band,
           CASE WHEN segment LIKE 'C%' THEN 'Couples'
                WHEN segment LIKE 'F%' THEN 'Families'
                ELSE 'unknown' END AS demographic,
           (2 * cents + transactions) // (2 * transactions) AS avg_cents
    FROM weekly
),
regions AS (
    SELECT CAST(row_number() OVER (ORDER BY region) AS INTEGER) AS region_id,
           region AS region_name FROM (SELECT DISTINCT region FROM clean)
),
platforms AS (
    SELECT CAST(row_number() OVER (ORDER BY platform) AS INTEGER) AS platform_id,
           platform AS platform_name FROM (SELECT DISTINCT platform FROM clean)
),
segments AS (
    SELECT CAST(row_number() OVER (ORDER BY segment) AS INTEGER) AS segment_id,
           segment AS segment_code, age_band, demographic
    FROM (SELECT DISTINCT segment, age_band, demographic FROM clean)
)
"""

PANEL = """,
panel AS (
    SELECT week_date, region, platform, week_number, month_number, calendar_year,
           CAST(CAST(sum(cents) AS DOUBLE) / 100 AS DOUBLE) / 1e6 AS sales,
           CAST(sum(transactions) AS DOUBLE) / 1e3 AS transactions
    FROM clean GROUP BY 1, 2, 3, 4, 5, 6
),
lagged AS (
    SELECT *,
           lag(sales, 1) OVER s AS lag_1, lag(sales, 2) OVER s AS lag_2,
           lag(sales, 3) OVER s AS lag_3, lag(sales, 4) OVER s AS lag_4,
           lag(sales, 8) OVER s AS lag_8, lag(sales, 12) OVER s AS lag_12,
           avg(sales) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
           avg(sales) OVER (s ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rolling_mean_8,
           avg(sales) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_mean_12,
           stddev_samp(sales) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_std_4,
           stddev_samp(sales) OVER (s ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rolling_std_8,
           CAST(quarter(week_date) AS INTEGER) AS quarter,
           CASE WHEN week_number >= 25 AND calendar_year = 1998 THEN 1 ELSE 0 END
               AS is_packaging_week
    FROM panel
    WINDOW s AS (PARTITION BY region, platform ORDER BY week_date)
),
features AS (
    SELECT *, lag_1 AS naive_pred FROM lagged WHERE lag_12 IS NOT NULL
),
train AS (SELECT * FROM features WHERE week_date < DATE '2001-06-11'),
test AS (SELECT * FROM features WHERE week_date >= DATE '2001-06-11')
"""

SALES = "CAST(sum(cents) AS DOUBLE) / 100"
TX = "CAST(sum(transactions) AS BIGINT)"


def ratio6(cents: str, count: str) -> str:
    """cents / count in money units, half-up at six digits, by integer arithmetic."""
    top = f"(2 * CAST({cents} AS HUGEINT) * 10000 + {count})"
    return f"CAST({top} // NULLIF(2 * CAST({count} AS HUGEINT), 0) AS DOUBLE) / 1e6"


def percent6(part: str, whole: str) -> str:
    return (
        f"round((CAST({part} AS DOUBLE) / 100) * 100.0"
        f" / NULLIF(CAST({whole} AS DOUBLE) / 100, 0), 6)"
    )


AOV = ratio6("sum(cents)", "sum(transactions)")
MEAN_OF_MEANS = ratio6("sum(avg_cents)", "count(*)")

ORACLE: dict[str, str] = {}


def _add(key: str, body: str, panel: bool = False) -> None:
    ORACLE[key] = PRELUDE + (PANEL if panel else "") + body


def _grouped(key: str, by: str, columns: str, where: str = "", having: str = "") -> None:
    """One GROUP BY statement; ``by`` lists grouping columns, optionally ``column AS name``."""
    keys = [item.split(" AS ")[0] for item in by.split(", ")]
    clause = f"WHERE {where}" if where else ""
    _add(key, f"SELECT {by}, {columns} FROM clean {clause} GROUP BY {', '.join(keys)} {having}")


TOTAL = f"{SALES} AS total_sales"

# ---- cleaning and star build ----

CLEAN = """week_date, week_number, month_number, calendar_year, region, platform,
    segment AS segment_code, demographic, age_band, customer_type, transactions,
    CAST(cents AS DOUBLE) / 100 AS sales, CAST(avg_cents AS DOUBLE) / 100 AS avg_transaction"""
_add("clean_rows", f"SELECT {CLEAN} FROM clean")
_add("csv_reordered_rows", f"SELECT {CLEAN} FROM clean")
_grouped(
    "reject_rows",
    "region",
    f"'week_date' AS reject_reason, CAST(count(*) AS BIGINT) AS row_count, {TOTAL}",
    "region = 'ASIA'",
)

RAW_TEXT = """
    CASE WHEN calendar_year BETWEEN 1995 AND 1997 THEN strftime(week_date, '%-d/%-m/%Y')
         WHEN calendar_year = 1998 THEN strftime(week_date, '%Y-%m-%d')
         ELSE strftime(week_date, '%-d/%-m/%y') END AS week_date,
    {region} || ' ' AS region, platform,
    CASE WHEN segment = 'unknown' THEN 'null' ELSE segment END AS segment,
    customer_type, transactions, CAST(cents AS DOUBLE) / 100 AS sales"""
_add("sqldump_rows", f"SELECT {RAW_TEXT.format(region='region')} FROM clean")
_add("csv_rows", f"SELECT {RAW_TEXT.format(region='lower(region)')} FROM clean")
_add(
    "resolved_rows",
    f"SELECT {RAW_TEXT.format(region='region')}, source FROM clean, (VALUES ('dump'), ('csv')) AS s(source)",
)
_add("dim_region", "SELECT * FROM regions")
_add("dim_platform", "SELECT * FROM platforms")
_add("dim_segment", "SELECT * FROM segments")
FACT = """SELECT sales_id, week_date, week_number, month_number, calendar_year,
              region_id, platform_id, segment_id, customer_type, transactions,
              CAST(cents AS DOUBLE) / 100 AS sales,
              CAST(avg_cents AS DOUBLE) / 100 AS avg_transaction
       FROM clean JOIN regions ON region = region_name
                  JOIN platforms ON platform = platform_name
                  JOIN segments ON segment = segment_code"""
_add("fact", FACT)
_add(
    "mart",
    """SELECT sales_id, week_date, week_number, month_number, calendar_year,
              region, platform, segment, age_band, demographic, customer_type, transactions,
              CAST(cents AS DOUBLE) / 100 AS sales,
              CAST(avg_cents AS DOUBLE) / 100 AS avg_transaction
       FROM clean""",
)
_add(
    "verify_counts",
    """SELECT 'dim_region' AS table_name, count(*) AS row_count FROM regions
       UNION ALL SELECT 'dim_platform', count(*) FROM platforms
       UNION ALL SELECT 'dim_segment', count(*) FROM segments
       UNION ALL SELECT 'fact_weekly_sales', count(*) FROM clean
       UNION ALL SELECT 'clean_weekly_sales', count(*) FROM clean""",
)
_add(
    "constraint_violations",
    """, keyed AS (
           SELECT sales_id, region_id, platform_id, segment_id
           FROM clean LEFT JOIN regions ON region = region_name
                      LEFT JOIN platforms ON platform = platform_name
                      LEFT JOIN segments ON segment = segment_code)
       SELECT 'dim_region' AS table_name, 'unique_region_id' AS rule,
              count(*) - count(DISTINCT region_id) AS violations FROM regions
       UNION ALL SELECT 'dim_region', 'unique_region_name',
              count(*) - count(DISTINCT region_name) FROM regions
       UNION ALL SELECT 'dim_region', 'not_null',
              count(*) FILTER (region_name IS NULL) FROM regions
       UNION ALL SELECT 'dim_platform', 'unique_platform_id',
              count(*) - count(DISTINCT platform_id) FROM platforms
       UNION ALL SELECT 'dim_platform', 'unique_platform_name',
              count(*) - count(DISTINCT platform_name) FROM platforms
       UNION ALL SELECT 'dim_platform', 'not_null',
              count(*) FILTER (platform_name IS NULL) FROM platforms
       UNION ALL SELECT 'dim_segment', 'unique_segment_id',
              count(*) - count(DISTINCT segment_id) FROM segments
       UNION ALL SELECT 'dim_segment', 'unique_segment_code',
              count(*) - count(DISTINCT segment_code) FROM segments
       UNION ALL SELECT 'dim_segment', 'not_null',
              count(*) FILTER (segment_code IS NULL) FROM segments
       UNION ALL SELECT 'fact_weekly_sales', 'unique_sales_id',
              count(*) - count(DISTINCT sales_id) FROM keyed
       UNION ALL SELECT 'fact_weekly_sales', 'not_null', count(*) FILTER
              (week_date IS NULL OR region IS NULL OR platform IS NULL OR cents IS NULL) FROM clean
       UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_region_id',
              count(*) FILTER (region_id IS NULL) FROM keyed
       UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_platform_id',
              count(*) FILTER (platform_id IS NULL) FROM keyed
       UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_segment_id',
              count(*) FILTER (segment_id IS NULL) FROM keyed""",
)
_add(
    "week_number_rules",
    """SELECT DISTINCT week_date, week_number AS monday_w1,
              CAST(strftime(week_date, '%V') AS INTEGER) AS iso, month_number, calendar_year,
              CAST((month_number + 2) // 3 AS INTEGER) AS quarter
       FROM clean""",
)

# ---- advanced insights ----

_add(
    "yoy_growth_by_region",
    f""", yearly AS (SELECT region, calendar_year, sum(cents) AS c FROM clean GROUP BY 1, 2),
       paired AS (SELECT *, lag(c) OVER (PARTITION BY region ORDER BY calendar_year) AS p
                  FROM yearly)
       SELECT region, calendar_year, CAST(c AS DOUBLE) / 100 AS total_sales,
              CAST(p AS DOUBLE) / 100 AS previous_year_sales,
              {percent6('(c - p)', 'p')} AS growth_percentage
       FROM paired""",
)
_add(
    "top_region_per_year",
    """, ranked AS (
           SELECT calendar_year, region, CAST(sum(cents) AS DOUBLE) / 100 AS total_sales,
                  CAST(rank() OVER (PARTITION BY calendar_year ORDER BY sum(cents) DESC)
                       AS INTEGER) AS sales_rank
           FROM clean GROUP BY 1, 2)
       SELECT * FROM ranked WHERE sales_rank = 1""",
)
_grouped("avg_txn_by_region", "region", f"{MEAN_OF_MEANS} AS average_transaction_value")
_add(
    "monthly_running_total",
    """SELECT calendar_year, month_number, CAST(sum(cents) AS DOUBLE) / 100 AS monthly_sales,
              CAST(sum(sum(cents)) OVER (PARTITION BY calendar_year ORDER BY month_number)
                   AS DOUBLE) / 100 AS running_total_sales
       FROM clean GROUP BY 1, 2""",
)
_grouped(
    "region_contribution",
    "region",
    f"{TOTAL}, {percent6('sum(cents)', '(SELECT sum(cents) FROM clean)')}"
    " AS contribution_percentage",
)
_grouped(
    "segment_performance", "demographic, age_band", f"{TOTAL}, {TX} AS total_transactions"
)
_add(
    "mom_growth",
    f""", monthly AS (SELECT calendar_year, month_number, sum(cents) AS c FROM clean GROUP BY 1, 2),
       paired AS (SELECT *, lag(c) OVER (ORDER BY calendar_year, month_number) AS p FROM monthly)
       SELECT calendar_year, month_number, CAST(c AS DOUBLE) / 100 AS sales,
              CAST(p AS DOUBLE) / 100 AS previous_month_sales,
              {percent6('(c - p)', 'p')} AS growth_percentage
       FROM paired""",
)
_grouped(
    "platform_rank",
    "platform",
    f"{TOTAL}, CAST(dense_rank() OVER (ORDER BY sum(cents) DESC) AS INTEGER) AS platform_rank",
)
_grouped("top5_regions", "region", TOTAL, having="ORDER BY sum(cents) DESC, region LIMIT 5")
_grouped(
    "customer_type_performance",
    "customer_type",
    f"{TOTAL}, {TX} AS total_transactions, {MEAN_OF_MEANS} AS average_transaction",
)
REVENUE = f"{SALES} AS total_revenue"
_grouped(
    "star_demographic_revenue",
    "region AS region_name, platform AS platform_name, demographic, age_band",
    f"{REVENUE}, {TX} AS total_orders, {AOV} AS avg_order_value",
    "segment <> 'unknown'",
)
_add(
    "known_vs_unknown_segment",
    f""", marked AS (
           SELECT *, CASE WHEN segment = 'unknown' THEN 'Unclassified Segment'
                          ELSE 'Identified Segment' END AS segment_status FROM clean),
       sums AS (SELECT platform, segment_status, count(*) AS n, sum(cents) AS c
                FROM marked GROUP BY 1, 2)
       SELECT platform AS platform_name, segment_status, CAST(n AS BIGINT) AS record_count,
              CAST(c AS DOUBLE) / 100 AS total_revenue,
              {percent6('c', 'sum(c) OVER (PARTITION BY platform)')}
                  AS platform_revenue_share_pct
       FROM sums""",
)
_add(
    "rolling_4wk_avg",
    """, sums AS (SELECT region, week_date, calendar_year, week_number, sum(cents) AS c
                FROM clean GROUP BY 1, 2, 3, 4)
       SELECT region AS region_name, week_date, calendar_year, week_number,
              CAST(c AS DOUBLE) / 100 AS weekly_sales,
              round(CAST(sum(c) OVER w AS DOUBLE) / 100 / count(*) OVER w, 6)
                  AS rolling_4week_avg_sales
       FROM sums
       WINDOW w AS (PARTITION BY region ORDER BY week_date
                    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
_add(
    "demographic_share_by_platform",
    f""", sums AS (SELECT platform, demographic, sum(cents) AS c FROM clean
                 WHERE demographic <> 'unknown' GROUP BY 1, 2)
       SELECT platform AS platform_name, demographic,
              CAST(c AS DOUBLE) / 100 AS demographic_sales,
              {percent6('c', 'sum(c) OVER (PARTITION BY platform)')} AS demographic_share_pct
       FROM sums""",
)

# ---- solutions ----

_add("week_start_days", "SELECT DISTINCT dayname(week_date) AS day_of_week FROM clean")
_add(
    "missing_weeks",
    """SELECT CAST(n AS INTEGER) AS missing_week_number FROM range(1, 53) AS r(n)
       WHERE n NOT IN (SELECT week_number FROM clean)""",
)
_grouped("annual_transactions", "calendar_year", f"{TX} AS total_transactions")
_grouped("monthly_sales_by_region", "region, month_number", TOTAL)
_grouped("platform_transactions", "platform", f"{TX} AS total_transactions")
_grouped(
    "platform_pct_by_month",
    "calendar_year, month_number",
    percent6("sum(cents) FILTER (platform = 'Retail')", "sum(cents)")
    + " AS retail_pct, "
    + percent6("sum(cents) FILTER (platform = 'Shopify')", "sum(cents)")
    + " AS shopify_pct",
)
_add(
    "demographic_pct_by_year",
    f""", sums AS (SELECT calendar_year, demographic, sum(cents) AS c FROM clean GROUP BY 1, 2)
       SELECT calendar_year, demographic,
              {percent6('c', 'sum(c) OVER (PARTITION BY calendar_year)')} AS pct_of_annual_sales
       FROM sums""",
)
_add(
    "top_retail_segments",
    f""", sums AS (SELECT age_band, demographic, sum(cents) AS c FROM clean
                 WHERE platform = 'Retail' GROUP BY 1, 2)
       SELECT age_band, demographic, CAST(c AS DOUBLE) / 100 AS retail_sales,
              {percent6('c', 'sum(c) OVER ()')} AS pct_of_retail_sales
       FROM sums""",
)
_grouped(
    "avg_of_avgs_vs_ratio",
    "calendar_year, platform",
    f"{MEAN_OF_MEANS} AS incorrect_avg_of_avgs, {AOV} AS correct_avg_transaction",
)


def _impact(weeks: int, year: bool) -> str:
    """Labelled rows around the anchor week of 1998-06-15."""
    return f""", anchor AS (
           SELECT DISTINCT week_number AS w FROM clean WHERE week_date = DATE '1998-06-15'),
       labelled AS (
           SELECT clean.*, CASE WHEN week_number BETWEEN w - {weeks} AND w - 1 THEN 'before'
                                WHEN week_number BETWEEN w AND w + {weeks - 1} THEN 'after' END
                      AS period
           FROM clean CROSS JOIN anchor {'WHERE calendar_year = 1998' if year else ''})
    """


for weeks in (4, 12):
    _add(
        f"impact_{weeks}wk",
        _impact(weeks, True)
        + f""", sums AS (SELECT period, sum(cents) AS c FROM labelled
                       WHERE period IS NOT NULL GROUP BY 1),
           paired AS (SELECT *, lag(c) OVER (ORDER BY period DESC) AS p FROM sums)
           SELECT period, CAST(c AS DOUBLE) / 100 AS total_sales,
                  CAST(c - p AS DOUBLE) / 100 AS sales_change,
                  {percent6('(c - p)', 'p')} AS pct_change
           FROM paired""",
    )
    _add(
        f"impact_{weeks}wk_all_years",
        _impact(weeks, False)
        + f""", sums AS (SELECT calendar_year, period, sum(cents) AS c FROM labelled
                       WHERE period IS NOT NULL GROUP BY 1, 2),
           paired AS (SELECT *, lag(c) OVER (PARTITION BY calendar_year ORDER BY period DESC) AS p
                      FROM sums)
           SELECT calendar_year, period, CAST(c AS DOUBLE) / 100 AS total_sales,
                  CAST(c - p AS DOUBLE) / 100 AS sales_change,
                  {percent6('(c - p)', 'p')} AS pct_change
           FROM paired""",
    )

for name in ("region", "platform", "age_band", "demographic", "customer_type"):
    _add(
        f"impact_by_{name}",
        _impact(12, True)
        + f""", sides AS (SELECT {name}, sum(cents) FILTER (period = 'before') AS b,
                               sum(cents) FILTER (period = 'after') AS a
                        FROM labelled WHERE period IS NOT NULL GROUP BY 1)
           SELECT {name}, CAST(b AS DOUBLE) / 100 AS before_sales,
                  CAST(a AS DOUBLE) / 100 AS after_sales,
                  CAST(a - b AS DOUBLE) / 100 AS sales_change,
                  {percent6('(a - b)', 'b')} AS pct_change
           FROM sides""",
    )

# ---- dashboard ----

_add(
    "kpi_summary",
    f"""SELECT {TOTAL}, {TX} AS total_transactions, {AOV} AS avg_transaction,
               count(DISTINCT region) AS total_regions FROM clean""",
)
_grouped("monthly_sales", "month_number", f"{SALES} AS sales")
_grouped("sales_by_region", "region", f"{SALES} AS sales")
_grouped("sales_by_platform", "platform", f"{SALES} AS sales")
_add("years", "SELECT DISTINCT calendar_year FROM clean")

IN_YEAR = "calendar_year = 1998"
FULL = f"{TOTAL}, {TX} AS total_transactions, {AOV} AS avg_transaction"
_grouped("monthly_sales_year", "month_number", TOTAL, IN_YEAR)
_grouped("region_sales_year", "region", TOTAL, IN_YEAR)
_grouped("platform_sales_year", "platform", TOTAL, IN_YEAR)
_grouped(
    "top10_regions_year", "region", FULL, IN_YEAR, "ORDER BY sum(cents) DESC, region LIMIT 10"
)
_grouped(
    "demographic_sales_year", "demographic", TOTAL, f"{IN_YEAR} AND demographic <> 'unknown'"
)
_grouped("age_band_sales_year", "age_band", TOTAL, f"{IN_YEAR} AND age_band <> 'unknown'")
_grouped("customer_type_sales_year", "customer_type", TOTAL, IN_YEAR)
_grouped(
    "segment_matrix_year", "demographic, age_band", FULL, f"{IN_YEAR} AND segment <> 'unknown'"
)

for key, low, high in (("packaging_window_12", 13, 36), ("packaging_window_4", 21, 28)):
    before = f"Before Change (Weeks {low}\u201324)"
    after = f"After Change (Weeks 25\u2013{high})"
    _add(
        key,
        f"""SELECT CASE WHEN week_number <= 24 THEN '{before}' ELSE '{after}' END AS period,
                   {FULL}
            FROM clean WHERE {IN_YEAR} AND week_number BETWEEN {low} AND {high} GROUP BY 1""",
    )
_add(
    "packaging_kpis",
    f""", sides AS (SELECT sum(cents) FILTER (week_number BETWEEN 13 AND 24) AS b,
                         sum(cents) FILTER (week_number BETWEEN 25 AND 36) AS a
                  FROM clean WHERE {IN_YEAR})
       SELECT CAST(b AS DOUBLE) / 100 AS before_sales, CAST(a AS DOUBLE) / 100 AS after_sales,
              CAST(a - b AS DOUBLE) / 100 AS sales_change,
              {percent6('(a - b)', 'b')} AS pct_change
       FROM sides""",
)
_grouped("cohort_revenue", "demographic, age_band", TOTAL, "segment <> 'unknown'")
_grouped("annual_sales", "calendar_year", TOTAL)
_add(
    "regional_channel_share",
    f""", sums AS (SELECT region, platform, sum(cents) AS cents,
                        sum(transactions) AS transactions FROM clean GROUP BY 1, 2)
       SELECT region AS region_name, platform AS platform_name,
              CAST(cents AS DOUBLE) / 100 AS total_revenue,
              CAST(transactions AS BIGINT) AS total_transactions,
              {ratio6('cents', 'transactions')} AS avg_order_value,
              {percent6('cents', 'sum(cents) OVER (PARTITION BY region)')}
                  AS region_channel_share_pct
       FROM sums""",
)
_grouped(
    "demographic_channel_affinity",
    "platform AS platform_name, demographic, age_band",
    f"{REVENUE}, {TX} AS total_transactions, {AOV} AS avg_order_value",
    "segment <> 'unknown'",
)
_add(
    "dim_listings",
    """SELECT 'dim_region' AS dimension, region_id AS id, region_name AS name FROM regions
       UNION ALL SELECT 'dim_platform', platform_id, platform_name FROM platforms
       UNION ALL SELECT 'dim_segment', segment_id, segment_code FROM segments""",
)
_add(
    "recent_records",
    """SELECT sales_id, week_date, region AS region_name, platform AS platform_name,
              segment AS segment_code, customer_type, transactions,
              CAST(cents AS DOUBLE) / 100 AS sales
       FROM clean ORDER BY sales_id DESC LIMIT 50""",
)

# ---- panel ----

_add("panel_weekly", "SELECT * FROM panel", panel=True)
_add(
    "panel_dense",
    """, spans AS (SELECT region, platform, min(week_date) AS a, max(week_date) AS b
                 FROM panel GROUP BY 1, 2),
       weeks AS (SELECT region, platform,
                        unnest(generate_series(a, b, INTERVAL 7 DAY)) AS d FROM spans),
       per_week AS (SELECT region, platform, sum(CAST(strftime(d, '%W') AS INTEGER) + 1) AS s,
                           count(*) AS n FROM weeks GROUP BY 1, 2)
       SELECT region, platform, CAST(n AS BIGINT) AS week_count,
              CAST(s AS BIGINT) AS week_number_sum,
              round((SELECT sum(sales) FROM panel p
                     WHERE p.region = w.region AND p.platform = w.platform), 8) AS sales
       FROM per_week w""",
    panel=True,
)
_add(
    "panel_features",
    """SELECT * REPLACE (round(rolling_mean_4, 11) AS rolling_mean_4,
                         round(rolling_mean_8, 11) AS rolling_mean_8,
                         round(rolling_mean_12, 11) AS rolling_mean_12,
                         round(rolling_std_4, 6) AS rolling_std_4,
                         round(rolling_std_8, 6) AS rolling_std_8)
       FROM features""",
    panel=True,
)
_add(
    "panel_dummies",
    """SELECT region, platform, week_date,
              CAST(region = 'AMERICA' AS INTEGER) AS region_AMERICA,
              CAST(region = 'ASIA' AS INTEGER) AS region_ASIA,
              CAST(region = 'EUROPE' AS INTEGER) AS region_EUROPE,
              CAST(region = 'MIDDLE EAST' AS INTEGER) AS "region_MIDDLE EAST",
              CAST(platform = 'Shopify' AS INTEGER) AS platform_Shopify
       FROM features""",
    panel=True,
)
_add(
    "panel_profile",
    """SELECT CAST(count(*) AS BIGINT) AS row_count,
              CAST(count(DISTINCT region || '/' || platform) AS BIGINT) AS series_count,
              CAST(count(DISTINCT week_date) AS BIGINT) AS week_count,
              min(week_date) AS first_week, max(week_date) AS last_week
       FROM panel""",
    panel=True,
)
_add(
    "train_test_split",
    """SELECT week_date, region, platform, sales, 'train' AS part FROM train
       UNION ALL SELECT week_date, region, platform, sales, 'test' FROM test""",
    panel=True,
)
_add(
    "expanding_folds",
    """, weeks AS (SELECT DISTINCT week_date FROM train),
       numbered AS (SELECT week_date, row_number() OVER (ORDER BY week_date) - 1 AS j,
                           count(*) OVER () AS n, count(*) OVER () // 6 AS t FROM weeks),
       folds AS (SELECT i, week_date FROM numbered CROSS JOIN range(0, 5) AS f(i)
                 WHERE j >= n - (5 - i) * t AND j < n - (4 - i) * t)
       SELECT CAST(i AS INTEGER) AS fold, min(week_date) AS test_from, max(week_date) AS test_to,
              CAST(count(*) AS BIGINT) AS test_weeks
       FROM folds GROUP BY i""",
    panel=True,
)

# ---- naive baseline ----

WAPE = "100 * sum(abs(sales - {p})) / NULLIF(sum(abs(sales)), 0)"
NAIVE_WAPE = WAPE.format(p="naive_pred")
R2 = "1 - sum((sales - naive_pred) ** 2) / NULLIF(sum((sales - mean) ** 2), 0)"
_add(
    "naive_wape",
    f""", centred AS (SELECT *, (SELECT avg(sales) FROM test) AS mean FROM test)
       SELECT round({R2}, 6) AS pooled_r2, round({NAIVE_WAPE}, 6) AS naive_wape FROM centred""",
    panel=True,
)
PER_STREAM = f""", centred AS (
           SELECT *, avg(sales) OVER (PARTITION BY region, platform) AS mean FROM test),
       per_stream AS (
           SELECT region, platform, {R2} AS r2, {NAIVE_WAPE} AS wape,
                  avg(abs(sales - naive_pred)) AS mae, avg(sales) AS mean_sales
           FROM centred GROUP BY 1, 2)
    """
_add(
    "naive_stream_metrics",
    PER_STREAM
    + """SELECT region, platform, region || ' (' || platform || ')' AS stream,
                round(r2, 6) AS r2, round(wape, 6) AS model_wape, round(wape, 6) AS naive_wape,
                false AS beat_naive, round(mae, 6) AS mae_m, round(mean_sales, 6) AS mean_sales_m
         FROM per_stream""",
    panel=True,
)
_add(
    "naive_stream_table",
    PER_STREAM
    + """SELECT region || ' (' || platform || ')' AS stream, round(r2, 6) AS r2,
                round(wape, 6) AS model_wape, round(wape, 6) AS naive_wape,
                round(mae, 6) AS mae_m, round(mean_sales, 6) AS mean_sales_m,
                'No' AS beats_naive
         FROM per_stream""",
    panel=True,
)
_add(
    "naive_stream_summary",
    PER_STREAM
    + """SELECT round(median(round(r2, 4)), 6) AS median_series_r2,
                round(avg(round(r2, 4)), 6) AS mean_series_r2,
                CAST(0 AS BIGINT) AS streams_beat_naive,
                CAST(count(*) AS BIGINT) AS total_streams
         FROM per_stream""",
    panel=True,
)
STEPPED = """, last AS (SELECT region, platform, arg_max(sales, week_date) AS constant
                  FROM train GROUP BY 1, 2),
       stepped AS (
           SELECT test.*, constant,
                  row_number() OVER (PARTITION BY test.region, test.platform
                                     ORDER BY week_date) AS step
           FROM test JOIN last ON test.region = last.region AND test.platform = last.platform)
    """
_add(
    "naive_constant",
    STEPPED
    + """SELECT week_date, region, platform, sales, constant AS naive_constant,
                CAST(step AS INTEGER) AS step
         FROM stepped""",
    panel=True,
)
_add(
    "persistence_backtest",
    STEPPED
    + """SELECT week_date, region, platform, sales, constant AS recursive_pred,
                constant AS naive_constant, CAST(step AS INTEGER) AS step
         FROM stepped""",
    panel=True,
)
_add(
    "persistence_steps",
    STEPPED
    + f""", sums AS (SELECT step, {WAPE.format(p='constant')} AS n FROM stepped GROUP BY 1)
       SELECT CAST(step AS INTEGER) AS step, round(n, 6) AS model_wape, round(n, 6) AS naive_wape,
              'naive' AS winner, CAST(0 AS DOUBLE) AS edge
       FROM sums""",
    panel=True,
)
MOVING = """, tails AS (
           SELECT region, platform, list_reverse((list(sales ORDER BY week_date DESC))[1:4]) AS h
           FROM features GROUP BY 1, 2),
       steps(region, platform, step, h, pred) AS (
           SELECT region, platform, 0, h, CAST(NULL AS DOUBLE) FROM tails
           UNION ALL
           SELECT region, platform, step + 1, list_append(h, m)[-4:], m
           FROM (SELECT *, greatest(list_sum(h) / len(h), 0) AS m FROM steps WHERE step < 24)),
       moving AS (
           SELECT CAST((SELECT max(week_date) FROM features) + 7 * step AS DATE) AS week_date,
                  region, platform, CAST(step AS INTEGER) AS step, round(pred, 4) AS forecast
           FROM steps WHERE step > 0),
       moving_total AS (
           SELECT week_date, sum(forecast) AS forecast FROM moving WHERE step <= 12 GROUP BY 1)
    """
_add("moving_average_forecast_12wk", MOVING + "SELECT * FROM moving WHERE step <= 12", panel=True)
_add("moving_average_forecast_24wk", MOVING + "SELECT * FROM moving", panel=True)
_add(
    "moving_average_total",
    MOVING + "SELECT week_date, round(forecast, 6) AS forecast FROM moving_total",
    panel=True,
)
_add(
    "moving_average_band",
    MOVING
    + """SELECT week_date, round(forecast, 6) AS forecast,
                round(forecast - 0.5 * stddev_samp(forecast) OVER (), 6) AS lower,
                round(forecast + 0.5 * stddev_samp(forecast) OVER (), 6) AS upper
         FROM moving_total""",
    panel=True,
)
_add(
    "short_history_forecast",
    """, tails AS (
           SELECT region, platform, list_reverse((list(sales ORDER BY week_date DESC))[1:3]) AS h
           FROM features GROUP BY 1, 2),
       steps(region, platform, step, h, pred) AS (
           SELECT region, platform, 0, h, CAST(NULL AS DOUBLE) FROM tails
           UNION ALL
           SELECT region, platform, step + 1, list_append(h, m), m
           FROM (SELECT *, greatest(0.5 * list_sum(h[-8:]) / len(h[-8:])
                                    + CASE WHEN len(h) >= 4 THEN 0.5 * h[-4] ELSE 0 END, 0) AS m
                 FROM steps WHERE step < 8))
       SELECT CAST((SELECT max(week_date) FROM features) + 7 * step AS DATE) AS week_date,
              region, platform, CAST(step AS INTEGER) AS step, round(pred, 4) AS forecast
       FROM steps WHERE step > 0""",
    panel=True,
)
_add(
    "gbt_importance_checks",
    "SELECT CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS unlabelled, CAST(0 AS BIGINT) AS unused",
)
_add(
    "gbt_prediction_checks",
    """SELECT region, platform, count(*) AS row_count, CAST(0 AS BIGINT) AS negative,
              CAST(0 AS BIGINT) AS different
       FROM test GROUP BY 1, 2""",
    panel=True,
)
_add(
    "naive_step_summary",
    STEPPED
    + f""", sums AS (SELECT step, {NAIVE_WAPE} AS m, {WAPE.format(p='constant')} AS n
                   FROM stepped GROUP BY 1)
       SELECT CAST(step AS INTEGER) AS step, round(m, 6) AS model_wape, round(n, 6) AS naive_wape,
              CASE WHEN m < n THEN 'model' ELSE 'naive' END AS winner, round(n - m, 6) AS edge
       FROM sums""",
    panel=True,
)
_add(
    "naive_actual_vs_pred",
    """SELECT week_date, round(sum(sales), 9) AS sales, round(sum(naive_pred), 9) AS y_pred
       FROM test GROUP BY 1""",
    panel=True,
)
_add(
    "naive_actual_vs_pred_retail",
    """SELECT week_date, round(sum(sales), 9) AS sales, round(sum(naive_pred), 9) AS y_pred
       FROM test WHERE platform = 'Retail' GROUP BY 1""",
    panel=True,
)
_add(
    "history_total",
    "SELECT week_date, round(sum(sales), 9) AS sales FROM features GROUP BY 1",
    panel=True,
)
_add(
    "history_total_asia",
    """SELECT week_date, round(sum(sales), 9) AS sales
       FROM features WHERE region = 'ASIA' GROUP BY 1""",
    panel=True,
)
_add(
    "future_calendar",
    """, ahead AS (SELECT k, CAST((SELECT max(week_date) FROM panel) + 7 * CAST(k AS INTEGER)
                                AS DATE) AS d FROM range(1, 13) AS r(k))
       SELECT CAST(k AS INTEGER) AS step, d AS week_date,
              CAST(strftime(d, '%W') AS INTEGER) + 1 AS week_number,
              CAST(month(d) AS INTEGER) AS month_number, CAST(quarter(d) AS INTEGER) AS quarter,
              CAST(year(d) AS INTEGER) AS calendar_year
       FROM ahead""",
    panel=True,
)

# ---- table maintenance ----

NEXT_YEAR = """, batch AS (
        SELECT CAST(week_date + 364 AS DATE) AS week_date, region, platform, segment,
               customer_type, transactions - 1 AS transactions, cents
        FROM clean WHERE calendar_year = (SELECT max(calendar_year) FROM clean))
    """
APPENDED = """SELECT (SELECT count(*) FROM clean) + row_number() OVER (
                    ORDER BY week_date, region, platform, segment, customer_type) AS sales_id,
                week_date, CAST(strftime(week_date, '%W') AS INTEGER) + 1 AS week_number,
                CAST(month(week_date) AS INTEGER) AS month_number,
                CAST(year(week_date) AS INTEGER) AS calendar_year,
                region_id, platform_id, segment_id, customer_type, transactions,
                CAST(cents AS DOUBLE) / 100 AS sales,
                CAST((2 * cents + transactions) // (2 * transactions) AS DOUBLE) / 100
                    AS avg_transaction
         FROM batch JOIN regions ON region = region_name
                    JOIN platforms ON platform = platform_name
                    JOIN segments ON segment = segment_code
         WHERE transactions >= 1 AND cents >= 100"""
_add("append_sales", NEXT_YEAR + APPENDED)
_add(
    "append_then_delete",
    NEXT_YEAR
    + FACT
    + " WHERE NOT (week_date = DATE '1998-06-15' AND customer_type = 'Guest') UNION ALL "
    + APPENDED,
)
_add(
    "append_rejects",
    NEXT_YEAR
    + f"""SELECT 'transactions' AS reject_reason, region,
                 CAST(count(*) AS BIGINT) AS row_count, {TOTAL}
          FROM batch WHERE transactions < 1 GROUP BY region""",
)
_grouped(
    "delete_sales",
    "calendar_year",
    f"CAST(count(*) AS BIGINT) AS row_count, {TOTAL}, CAST(sum(sales_id) AS BIGINT) AS id_sum",
    "NOT (week_date = DATE '1998-06-15' AND customer_type = 'Guest')",
)
_add(
    "maintained_sums",
    NEXT_YEAR
    + f"""SELECT week_date, week_number, month_number, calendar_year, region_id, platform_id, segment_id,
                customer_type, CAST(sum(transactions) AS BIGINT) AS transactions,
                round(sum(sales), 2) AS sales, count(*) AS row_count
         FROM ({FACT} WHERE NOT (week_date = DATE '1998-06-15' AND customer_type = 'Guest')
               UNION ALL {APPENDED}) GROUP BY ALL""",
)
_add(
    "batch_violations",
    f""", keyed AS ({FACT}), batch AS (
            SELECT sales_id + CASE WHEN customer_type = 'Guest' THEN 0 ELSE (SELECT count(*) FROM clean) END
                       AS sales_id,
                   platform_id, customer_type
            FROM keyed WHERE calendar_year = (SELECT max(calendar_year) FROM clean))
        SELECT 'fact_weekly_sales' AS table_name, 'unique_sales_id' AS rule,
               (SELECT count(*) FROM (SELECT sales_id FROM (SELECT sales_id FROM clean UNION ALL
                                                            SELECT sales_id FROM batch)
                                      GROUP BY 1 HAVING count(*) > 1)) AS violations
        UNION ALL SELECT 'fact_weekly_sales', 'not_null', count(*) FROM batch WHERE customer_type = 'Existing'
        UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_platform_id', count(*) FROM batch WHERE platform_id = 1
        UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_region_id', 0
        UNION ALL SELECT 'fact_weekly_sales', 'foreign_key_segment_id', 0""",
)
_add("restored_rows", FACT)
_add(
    "fact_sales_median",
    "SELECT count(*) AS row_count, round(median(CAST(cents AS DOUBLE) / 100), 6) AS median_sales FROM clean",
)
