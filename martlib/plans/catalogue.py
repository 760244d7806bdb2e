"""The query catalogue: every key is a parameterised instance of a generic operator.

Each query takes (spark, sf_dir), reads tables derived from the given ones, and returns
a lazy DataFrame. Percentages and ratios carry six digits here (the operators default
to two); decimals become doubles as the very last step.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import cleaning as C
from martlib.functions.measures import percent, ratio
from martlib.operators import bi, evaluate, forecast, impact, maintain, model, panel, quality, rank, star
from martlib.operators.clean import clean_weekly_sales, split_rejects
from martlib.operators.star import Star
from martlib.plans import workspace as W
from martlib.sources import raw as raw_sources
from martlib.sources.query import run_query
from martlib.storage import new_path

# Fixed values for the given tables (FIXTURES.md).
ANCHOR = date(1998, 6, 15)
YEAR = 1998
DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals to doubles, after all exact arithmetic is done."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def on_workspace(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(make(W.workspace(spark, sf_dir)))

    QUERIES[make.__name__] = run
    return make


def on_star(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(make(W.workspace(spark, sf_dir).star))

    QUERIES[make.__name__] = run
    return make


def totals(s: Star, by: list[str], sales: str = "total_sales", tx: str | None = None, **kw):
    """Summed sales (and transactions) per group under report names."""
    measures = ["sales", "transactions"] if tx else ["sales"]
    summed = bi.rollup_sum(s, by, measures, **kw).withColumnRenamed("sales", sales)
    return summed.withColumnRenamed("transactions", tx) if tx else summed


def known(column: str):
    return F.col(column) != "unknown"


# ---- cleaning and star build -------------------------------------------------------


@on_workspace
def clean_rows(w):
    accepted, _ = split_rejects(clean_weekly_sales(w.raw))
    return accepted


@on_workspace
def reject_rows(w):
    """What the cleaner refuses, from raw rows whose date text is damaged for one region."""
    damaged = F.when(F.upper(F.trim("region")) == "ASIA", F.concat("week_date", F.lit("?")))
    raw = w.raw.withColumn("week_date", F.coalesce(damaged, "week_date"))
    _, rejected = split_rejects(clean_weekly_sales(raw))
    return rejected.groupBy("reject_reason", "region").agg(
        F.count("*").alias("row_count"), F.sum("sales").alias("total_sales")
    )


@on_workspace
def sqldump_rows(w):
    """Raw rows written as SQL dump text and recovered from it."""
    fields = [F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")) for c in w.raw.columns]
    line = F.concat(F.lit("("), F.concat_ws(", ", *fields), F.lit("),"))
    path = new_path(w.spark, "dump")
    w.raw.select(line.alias("value")).write.text(path)
    return raw_sources.read_raw_sqldump(w.spark, path)


@on_workspace
def csv_rows(w):
    """Raw rows written as CSV and read back."""
    path = new_path(w.spark, "csv")
    raw_sources.write_csv(w.raw, path)
    return raw_sources.read_raw_csv(w.spark, path)


@on_workspace
def csv_reordered_rows(w):
    """Clean rows from a CSV with other columns' order, tabs and whole numbers as fractions."""
    path = new_path(w.spark, "csv-reordered")
    text = w.raw.select(
        F.lit("x").alias("note"),
        F.concat(F.lit("\t"), "region").alias("region"),
        "sales",
        F.concat(F.col("transactions").cast("string"), F.lit(".0")).alias("transactions"),
        F.concat(F.lit("\t"), "segment", F.lit("\t")).alias("segment"),
        "customer_type",
        F.concat("platform", F.lit(" \t")).alias("platform"),
        F.concat(F.lit("\t"), "week_date").alias("week_date"),
    )
    raw_sources.write_csv(text, path)
    return clean_weekly_sales(raw_sources.read_raw_csv(w.spark, path)).drop("raw_week_date")


@on_workspace
def resolved_rows(w):
    """Raw rows when only a dump is there, and again when that run's CSV is."""
    fields = [F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")) for c in w.raw.columns]
    dump, csv = new_path(w.spark, "dump"), new_path(w.spark, "resolved")
    w.raw.select(F.concat(F.lit("("), F.concat_ws(", ", *fields), F.lit("),")).alias("value")).write.text(dump)
    first = raw_sources.resolve_raw(w.spark, csv, dump).withColumn("source", F.lit("dump"))
    again = raw_sources.resolve_raw(w.spark, csv, "no such dump").withColumn("source", F.lit("csv"))
    return first.unionByName(again)


@on_star
def dim_region(s):
    return s.dim_region


@on_star
def dim_platform(s):
    return s.dim_platform


@on_star
def dim_segment(s):
    return s.dim_segment


@on_star
def fact(s):
    return s.fact


@on_star
def mart(s):
    return star.mart(s)


@on_star
def verify_counts(s):
    return star.verify_counts(s)


@on_star
def constraint_violations(s):
    return star.check_constraints(s)


@on_workspace
def week_number_rules(w):
    """Both week rules beside each other for every week in the data."""
    weeks = clean_weekly_sales(w.raw).select("week_date").distinct()
    d = F.col("week_date")
    return weeks.select(
        d,
        C.week_number(d, "monday_w1").alias("monday_w1"),
        C.month_number(d).alias("month_number"),
        C.calendar_year(d).alias("calendar_year"),
        C.week_number(d, "iso").alias("iso"),
        C.quarter(d).alias("quarter"),
    )


# ---- advanced insights -------------------------------------------------------------


@on_star
def yoy_growth_by_region(s):
    yearly = totals(s, ["region_name", "calendar_year"]).withColumnRenamed("region_name", "region")
    return bi.growth(
        yearly,
        "total_sales",
        ["region"],
        ["calendar_year"],
        "previous_year_sales",
        "growth_percentage",
        DIGITS,
    )


@on_star
def top_region_per_year(s):
    yearly = totals(s, ["calendar_year", "region_name"]).withColumnRenamed("region_name", "region")
    return bi.rank_top(yearly, "total_sales", ["calendar_year"], "sales_rank")


@on_star
def avg_txn_by_region(s):
    sums = bi.rollup_sum(s, ["region_name"], ["avg_transaction", "records"])
    return sums.select(
        F.col("region_name").alias("region"),
        ratio(F.col("avg_transaction"), F.col("records"), DIGITS).alias(
            "average_transaction_value"
        ),
    )


@on_star
def monthly_running_total(s):
    monthly = totals(s, ["calendar_year", "month_number"], "monthly_sales")
    return bi.running_total(
        monthly, "monthly_sales", ["calendar_year"], "month_number", "running_total_sales"
    )


@on_star
def region_contribution(s):
    regions = totals(s, ["region_name"]).withColumnRenamed("region_name", "region")
    return bi.share_of(regions, "total_sales", [], "contribution_percentage", DIGITS)


@on_star
def segment_performance(s):
    return totals(s, ["demographic", "age_band"], tx="total_transactions")


@on_star
def mom_growth(s):
    monthly = totals(s, ["calendar_year", "month_number"], "sales")
    return bi.growth(
        monthly,
        "sales",
        [],
        ["calendar_year", "month_number"],
        "previous_month_sales",
        "growth_percentage",
        DIGITS,
    )


@on_star
def platform_rank(s):
    platforms = totals(s, ["platform_name"]).withColumnRenamed("platform_name", "platform")
    return bi.dense_ranked(platforms, "total_sales", "platform_rank")


@on_star
def top5_regions(s):
    regions = totals(s, ["region_name"]).withColumnRenamed("region_name", "region")
    return bi.top_k(regions, "total_sales", "region", 5)


@on_star
def customer_type_performance(s):
    sums = bi.rollup_sum(
        s, ["customer_type"], ["sales", "transactions", "avg_transaction", "records"]
    )
    return sums.select(
        "customer_type",
        F.col("sales").alias("total_sales"),
        F.col("transactions").alias("total_transactions"),
        ratio(F.col("avg_transaction"), F.col("records"), DIGITS).alias("average_transaction"),
    )


@on_star
def star_demographic_revenue(s):
    by = ["region_name", "platform_name", "demographic", "age_band"]
    sums = totals(s, by, "total_revenue", "total_orders", dim_filter=known("segment_code"))
    return bi.ratio_of_sums(sums, "total_revenue", "total_orders", "avg_order_value", DIGITS)


@on_star
def known_vs_unknown_segment(s):
    """A fact row without a matching segment counts as identified, as in the source report."""
    sums = bi.rollup_sum(s, ["platform_name", "segment_code"], ["records", "sales"], how="left")
    status = F.when(F.col("segment_code") == "unknown", "Unclassified Segment").otherwise(
        "Identified Segment"
    )
    by_status = sums.groupBy("platform_name", status.alias("segment_status")).agg(
        F.sum("records").alias("record_count"), F.sum("sales").alias("total_revenue")
    )
    return bi.share_of(
        by_status, "total_revenue", ["platform_name"], "platform_revenue_share_pct", DIGITS
    )


@on_star
def rolling_4wk_avg(s):
    weekly = totals(
        s, ["region_name", "week_date", "calendar_year", "week_number"], "weekly_sales"
    )
    return bi.rolling_avg(
        weekly, "weekly_sales", ["region_name"], "week_date", 4, "rolling_4week_avg_sales", DIGITS
    )


@on_star
def demographic_share_by_platform(s):
    sums = totals(
        s,
        ["platform_name", "demographic"],
        "demographic_sales",
        dim_filter=known("demographic"),
    )
    return bi.share_of(
        sums, "demographic_sales", ["platform_name"], "demographic_share_pct", DIGITS
    )


# ---- solutions ---------------------------------------------------------------------


@on_star
def week_start_days(s):
    return quality.week_start_days(s)


@on_star
def missing_weeks(s):
    return quality.missing_weeks(s)


@on_star
def annual_transactions(s):
    return s.fact.groupBy("calendar_year").agg(F.sum("transactions").alias("total_transactions"))


@on_star
def monthly_sales_by_region(s):
    return totals(s, ["region_name", "month_number"]).withColumnRenamed("region_name", "region")


@on_star
def platform_transactions(s):
    sums = bi.rollup_sum(s, ["platform_name"], ["transactions"])
    return sums.select(
        F.col("platform_name").alias("platform"), F.col("transactions").alias("total_transactions")
    )


@on_star
def platform_pct_by_month(s):
    sums = bi.rollup_sum(s, ["calendar_year", "month_number", "platform_name"])

    def of(platform):
        return F.sum(F.when(F.col("platform_name") == platform, F.col("sales")))

    return sums.groupBy("calendar_year", "month_number").agg(
        percent(of("Retail"), F.sum("sales"), DIGITS).alias("retail_pct"),
        percent(of("Shopify"), F.sum("sales"), DIGITS).alias("shopify_pct"),
    )


@on_star
def demographic_pct_by_year(s):
    sums = totals(s, ["calendar_year", "demographic"])
    shares = bi.share_of(sums, "total_sales", ["calendar_year"], "pct_of_annual_sales", DIGITS)
    return shares.drop("total_sales")


@on_star
def top_retail_segments(s):
    sums = bi.rollup_sum(
        s,
        ["age_band", "demographic", "platform_name"],
        dim_filter=F.col("platform_name") == "Retail",
    )
    retail = sums.select("age_band", "demographic", F.col("sales").alias("retail_sales"))
    return bi.share_of(retail, "retail_sales", [], "pct_of_retail_sales", DIGITS)


@on_star
def avg_of_avgs_vs_ratio(s):
    return quality.avg_of_avgs_vs_ratio(s, DIGITS)


@on_star
def impact_4wk(s):
    return impact.period_impact(s, ANCHOR, 4, YEAR, digits=DIGITS)


@on_star
def impact_12wk(s):
    return impact.period_impact(s, ANCHOR, 12, YEAR, digits=DIGITS)


@on_star
def impact_4wk_all_years(s):
    return impact.period_impact(s, ANCHOR, 4, by=["calendar_year"], digits=DIGITS)


@on_star
def impact_12wk_all_years(s):
    return impact.period_impact(s, ANCHOR, 12, by=["calendar_year"], digits=DIGITS)


def _impact_by(key: str, column: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = W.workspace(spark, sf_dir).star
        wide = impact.period_impact_by(s, ANCHOR, 12, YEAR, column, DIGITS)
        return plain(wide.withColumnRenamed(column, name))

    QUERIES[key] = run


_impact_by("impact_by_region", "region_name", "region")
_impact_by("impact_by_platform", "platform_name", "platform")
_impact_by("impact_by_age_band", "age_band", "age_band")
_impact_by("impact_by_demographic", "demographic", "demographic")
_impact_by("impact_by_customer_type", "customer_type", "customer_type")


# ---- dashboard ---------------------------------------------------------------------


@on_star
def kpi_summary(s):
    return bi.kpi_summary(s, DIGITS)


@on_star
def monthly_sales(s):
    return totals(s, ["month_number"], "sales")


@on_star
def sales_by_region(s):
    return totals(s, ["region_name"], "sales").withColumnRenamed("region_name", "region")


@on_star
def sales_by_platform(s):
    return totals(s, ["platform_name"], "sales").withColumnRenamed("platform_name", "platform")


@on_star
def years(s):
    return s.fact.select("calendar_year").distinct()


def _sql(key: str, sql: str, params=(YEAR,)) -> None:
    """A dashboard statement run as parameterised SQL over the registered views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star.register_views(W.workspace(spark, sf_dir).star)
        return plain(run_query(spark, sql, params))

    QUERIES[key] = run


_sql(
    "monthly_sales_year",
    """
    SELECT month_number, SUM(sales) AS total_sales
    FROM fact_weekly_sales
    WHERE calendar_year = %s
    GROUP BY month_number
    """,
)
def _year_sums(key: str, measures: str = "sales") -> str:
    """One year's fact summed on an integer key, before any name is joined."""
    sums = ", ".join(f"SUM({m}) AS {m}" for m in measures.split())
    return f"SELECT {key}, {sums} FROM fact_weekly_sales WHERE calendar_year = {{year}} GROUP BY {key}"


_BY_REGION, _BY_PLATFORM = _year_sums("region_id"), _year_sums("platform_id")
_BY_SEGMENT = _year_sums("segment_id")
_ORDER_VALUE = "ROUND(TRY_DIVIDE(total_sales, total_transactions), 6) AS avg_transaction"

_sql(
    "region_sales_year",
    f"WITH y AS ({_BY_REGION.format(year='?')}) "
    "SELECT region_name AS region, sales AS total_sales FROM y JOIN dim_region USING (region_id)",
)
_sql(
    "platform_sales_year",
    f"WITH y AS ({_BY_PLATFORM.format(year=':year')}) "
    "SELECT platform_name AS platform, sales AS total_sales FROM y JOIN dim_platform USING (platform_id)",
    {"year": YEAR},
)
_sql(
    "top10_regions_year",
    f"WITH y AS ({_year_sums('region_id', 'sales transactions').format(year='%s')}), named AS ("
    "SELECT region_name AS region, sales AS total_sales, transactions AS total_transactions "
    "FROM y JOIN dim_region USING (region_id)) "
    f"SELECT *, {_ORDER_VALUE} FROM named ORDER BY total_sales DESC, region LIMIT 10",
)
for _part in ("demographic", "age_band"):
    _sql(
        f"{_part}_sales_year",
        f"WITH y AS ({_BY_SEGMENT.format(year='%s')}) "
        f"SELECT {_part}, SUM(sales) AS total_sales FROM y JOIN dim_segment USING (segment_id) "
        f"GROUP BY {_part} HAVING {_part} <> 'unknown'",
    )
_sql(
    "customer_type_sales_year",
    f"SELECT customer_type, sales AS total_sales FROM ({_year_sums('customer_type').format(year='%s')})",
)
_sql(
    "segment_matrix_year",
    f"WITH y AS ({_year_sums('segment_id', 'sales transactions').format(year='%s')}), cells AS ("
    "SELECT demographic, age_band, SUM(sales) AS total_sales, SUM(transactions) AS total_transactions "
    "FROM y JOIN (SELECT * FROM dim_segment WHERE segment_code <> 'unknown') USING (segment_id) "
    "GROUP BY demographic, age_band) "
    f"SELECT *, {_ORDER_VALUE} FROM cells",
)


@on_star
def packaging_window_12(s):
    return impact.fixed_window_impact(s, YEAR, (13, 24), (25, 36), DIGITS)


@on_star
def packaging_window_4(s):
    return impact.fixed_window_impact(s, YEAR, (21, 24), (25, 28), DIGITS)


@on_star
def packaging_kpis(s):
    return impact.fixed_window_kpis(s, YEAR, (13, 24), (25, 36), DIGITS)


@on_star
def cohort_revenue(s):
    return totals(s, ["demographic", "age_band"], dim_filter=known("segment_code"))


@on_star
def annual_sales(s):
    return totals(s, ["calendar_year"])


@on_star
def regional_channel_share(s):
    """Flagship: revenue, transactions, order value and share per region and platform."""
    sums = totals(s, ["region_name", "platform_name"], "total_revenue", "total_transactions")
    valued = bi.ratio_of_sums(
        sums, "total_revenue", "total_transactions", "avg_order_value", DIGITS
    )
    return bi.share_of(
        valued, "total_revenue", ["region_name"], "region_channel_share_pct", DIGITS
    )


@on_star
def demographic_channel_affinity(s):
    by = ["platform_name", "demographic", "age_band"]
    sums = totals(s, by, "total_revenue", "total_transactions", dim_filter=known("segment_code"))
    return bi.ratio_of_sums(sums, "total_revenue", "total_transactions", "avg_order_value", DIGITS)


@on_star
def dim_listings(s):
    def listing(dim, key, name):
        return s.table(dim).select(
            F.lit(dim).alias("dimension"), F.col(key).alias("id"), F.col(name).alias("name")
        )

    return (
        listing("dim_region", "region_id", "region_name")
        .unionByName(listing("dim_platform", "platform_id", "platform_name"))
        .unionByName(listing("dim_segment", "segment_id", "segment_code"))
        .orderBy("dimension", "name")
    )


@on_workspace
def recent_records(w):
    last_id = star.read_high_water(w.spark, w.star_path)
    return bi.latest_rows(w.star, 50, last_id).select(
        "sales_id",
        "week_date",
        F.col("region").alias("region_name"),
        F.col("platform").alias("platform_name"),
        F.col("segment").alias("segment_code"),
        "customer_type",
        "transactions",
        "sales",
    )


# ---- panel -------------------------------------------------------------------------


@on_star
def panel_weekly(s):
    return panel.panel_weekly(s)


@on_workspace
def panel_dense(w):
    """The panel with missing weeks filled, as one row per series.

    Panel sales have eight decimals, so a sum rounded to eight cannot sit on a tie.
    """
    return panel.densify(w.panel).groupBy(*panel.SERIES).agg(
        F.count("*").alias("week_count"),
        F.round(F.sum("sales"), 8).alias("sales"),
        F.sum("week_number").alias("week_number_sum"),
    )


@on_workspace
def panel_features(w):
    """Features straight from the panel. Means keep 11 digits, where they cannot tie."""
    made = panel.engineer_features(w.panel, W.INTERVENTION_YEAR, W.INTERVENTION_WEEK)
    rounded = {f"rolling_mean_{k}": F.round(f"rolling_mean_{k}", 11) for k in panel.MEAN_WINDOWS}
    rounded |= {f"rolling_std_{k}": F.round(f"rolling_std_{k}", 6) for k in panel.STD_WINDOWS}
    return made.withColumns(rounded)


@on_workspace
def panel_dummies(w):
    frame, columns = panel.encode_dummies(w.features, panel.dummy_levels(w.star))
    return frame.select(*panel.SERIES, panel.DATE, *columns[len(panel.BASE_FEATURES) :])


@on_workspace
def panel_profile(w):
    return panel.panel_profile(w.panel)


@on_workspace
def train_test_split(w):
    train, test = panel.split(w.features, W.SPLIT_DATE)
    keys = [panel.DATE, *panel.SERIES, panel.TARGET]
    parts = [(train, "train"), (test, "test")]
    named = [df.select(*keys, F.lit(part).alias("part")) for df, part in parts]
    return named[0].unionByName(named[1])


@on_workspace
def expanding_folds(w):
    return model.expanding_folds(panel.split(w.features, W.SPLIT_DATE)[0])


# ---- naive baseline ----------------------------------------------------------------


def _test(w) -> DataFrame:
    return panel.split(w.features, W.SPLIT_DATE)[1]


@on_workspace
def naive_wape(w):
    made = evaluate.pooled_metrics(_test(w), evaluate.NAIVE, digits=DIGITS)
    return made.select("pooled_r2", "naive_wape")


@on_workspace
def naive_stream_metrics(w):
    return evaluate.per_stream_metrics(_test(w), evaluate.NAIVE, digits=DIGITS)


@on_workspace
def naive_stream_summary(w):
    per_stream = evaluate.per_stream_metrics(_test(w), evaluate.NAIVE)
    return evaluate.stream_summary(per_stream, DIGITS)


@on_workspace
def naive_constant(w):
    """Test weeks beside the last training value of their series, numbered by step ahead."""
    train, test = panel.split(w.features, W.SPLIT_DATE)
    keys = [panel.DATE, *panel.SERIES, panel.TARGET]
    return evaluate.naive_constant(train, test).select(*keys, "naive_constant", "step")


@on_workspace
def naive_step_summary(w):
    train, test = panel.split(w.features, W.SPLIT_DATE)
    stepped = evaluate.naive_constant(train, test)
    return evaluate.step_summary(stepped, evaluate.NAIVE, digits=DIGITS)


@on_workspace
def naive_stream_table(w):
    per_stream = evaluate.per_stream_metrics(_test(w), evaluate.NAIVE, digits=DIGITS)
    return evaluate.stream_table(per_stream)


def _rounded_pairs(sums: DataFrame) -> DataFrame:
    return sums.select(
        panel.DATE, F.round("sales", 9).alias("sales"), F.round("y_pred", 9).alias("y_pred")
    )


@on_workspace
def naive_actual_vs_pred(w):
    return _rounded_pairs(evaluate.actual_vs_pred(_test(w), evaluate.NAIVE))


@on_workspace
def naive_actual_vs_pred_retail(w):
    return _rounded_pairs(evaluate.actual_vs_pred(_test(w), evaluate.NAIVE, platform="Retail"))


@on_workspace
def history_total(w):
    sums = evaluate.history_total(w.features)
    return sums.select(panel.DATE, F.round("sales", 9).alias("sales"))


@on_workspace
def history_total_asia(w):
    sums = evaluate.history_total(w.features, region="ASIA")
    return sums.select(panel.DATE, F.round("sales", 9).alias("sales"))


@on_workspace
def future_calendar(w):
    return forecast.future_calendar(w.panel, 12)


# ---- table maintenance -------------------------------------------------------------


def _next_year_rows(s: Star) -> DataFrame:
    """A batch to append: last year's rows 52 weeks later with one transaction less.

    Rows left without a transaction break the input rules and are rejected.
    """
    rows = star.mart(s)
    last_year = s.fact.agg(F.max("calendar_year")).scalar()
    return rows.filter(F.col("calendar_year") == last_year).select(
        F.date_add("week_date", 364).alias("week_date"),
        "region",
        "platform",
        "segment",
        "customer_type",
        (F.col("transactions") - 1).alias("transactions"),
        "sales",
    )


@on_workspace
def append_sales(w):
    last_id = star.read_high_water(w.spark, w.star_path)
    return maintain.new_facts(w.star, _next_year_rows(w.star), last_id)[0]


@on_workspace
def append_rejects(w):
    _, rejects = maintain.derive_new_facts(w.star, _next_year_rows(w.star))
    return rejects.groupBy("reject_reason", "region").agg(
        F.count("*").alias("row_count"), F.sum("sales").alias("total_sales")
    )


def _anchor_guest_ids(s: Star) -> DataFrame:
    return s.fact.filter(
        (F.col("calendar_year") == ANCHOR.year)
        & (F.col("week_date") == F.lit(ANCHOR))
        & (F.col("customer_type") == "Guest")
    ).select("sales_id")


@on_star
def delete_sales(s):
    """What is left per year after deleting the anchor week's guest rows by id."""
    return (
        maintain.without_ids(s.fact, _anchor_guest_ids(s))
        .groupBy("calendar_year")
        .agg(
            F.count("*").alias("row_count"),
            F.sum("sales").alias("total_sales"),
            F.sum("sales_id").alias("id_sum"),
        )
    )


@on_workspace
def append_then_delete(w):
    """The stored fact after appending a batch to a copy of the star and deleting by id."""
    path = new_path(w.spark, "maintained")
    star.write_star(w.star, path, star.read_high_water(w.spark, w.star_path))
    maintain.append_sales(w.spark, path, _next_year_rows(w.star))
    stored = star.read_star(w.spark, path)
    maintain.delete_sales(w.spark, path, _anchor_guest_ids(stored))
    return star.read_star(w.spark, path).fact


@on_workspace
def maintained_sums(w):
    """The sums kept beside the fact after an append and a delete, which no scan of it made."""
    path = new_path(w.spark, "summed")
    star.write_star(w.star, path, star.read_high_water(w.spark, w.star_path))
    maintain.append_sales(w.spark, path, _next_year_rows(w.star))
    maintain.delete_sales(w.spark, path, _anchor_guest_ids(star.read_star(w.spark, path)))
    return star.read_sums(w.spark, path)


def _batch_with_faults(s: Star) -> DataFrame:
    """Last year's rows a year later: guests' rows under their old ids, rows of one platform under
    a platform that is not there, existing customers' rows without sales, the rest with fresh ids."""
    last_year, top = s.fact.agg(F.max("calendar_year")).scalar(), s.fact.agg(F.max("sales_id")).scalar()
    guest = F.col("customer_type") == "Guest"
    return s.fact.filter(F.col("calendar_year") == last_year).withColumns(
        {
            "sales_id": F.when(guest, F.col("sales_id")).otherwise(F.col("sales_id") + top),
            "platform_id": F.when(F.col("platform_id") == 1, F.lit(99)).otherwise(F.col("platform_id")),
            "sales": F.when(F.col("customer_type") != "Existing", F.col("sales")),
        }
    )


@on_workspace
def batch_violations(w):
    """Constraints that a faulty batch would break, found without a scan of the stored fact."""
    return star.check_batch(w.spark, w.star_path, _batch_with_faults(w.star))


@on_workspace
def restored_rows(w):
    """The anchor week's guest rows deleted from a copy of the star, put back under their ids."""
    path = new_path(w.spark, "restored")
    star.write_star(w.star, path, star.read_high_water(w.spark, w.star_path))
    gone = w.star.fact.join(_anchor_guest_ids(w.star), "sales_id", "left_semi")
    maintain.delete_sales(w.spark, path, gone)
    maintain.append_facts(w.spark, path, gone)
    return star.read_star(w.spark, path).fact


@on_star
def fact_sales_median(s):
    """Exact median of single weekly sales, by refinement of buckets."""
    middle = rank.exact_median(s.fact, "sales", enough=1000)
    return s.fact.agg(F.count("*").alias("row_count"), F.round(F.lit(middle), DIGITS).alias("median_sales"))


# ---- boosted trees and recursive forecast ------------------------------------------


def _scored(w) -> DataFrame:
    return w.scored


@on_workspace
def gbt_predictions(w):
    keys = [panel.DATE, *panel.SERIES, panel.TARGET, evaluate.NAIVE, model.PREDICTION]
    return _scored(w).select(*keys)


@on_workspace
def saved_model_predictions(w):
    """Predictions of the model after it was saved and loaded again."""
    path = new_path(w.spark, "model")
    model.save_model(w.spark, w.model, path)
    loaded = model.load_model(w.spark, path)
    keys = [panel.DATE, *panel.SERIES, panel.TARGET, model.PREDICTION]
    return model.predict(loaded, w.split[1]).select(*keys)


@on_workspace
def gbt_metrics(w):
    return evaluate.evaluate(_scored(w), w.backtest, model.PREDICTION)[0]


@on_workspace
def gbt_stream_metrics(w):
    return evaluate.per_stream_metrics(_scored(w), model.PREDICTION)


@on_workspace
def gbt_actual_vs_pred(w):
    return evaluate.actual_vs_pred(_scored(w), model.PREDICTION)


@on_workspace
def gbt_importance(w):
    return model.feature_importance(w.model, w.spark, DIGITS)


@on_workspace
def gbt_grid_scores(w):
    """Time-ordered grid search over all of ``model.GRID``, 108 combinations on five folds."""
    _, scores = model.tune(w.split[0])
    return scores


@on_workspace
def persistence_backtest(w):
    """The recursive backtest of a rule instead of trees: each step repeats the last value."""
    return forecast.backtest_recursive(
        F.col("lag_1"), *w.split, in_year=W.INTERVENTION_YEAR, from_week=W.INTERVENTION_WEEK
    )


@on_workspace
def persistence_steps(w):
    return evaluate.step_summary(persistence_backtest(w), "recursive_pred", digits=DIGITS)


def _moving_average(w, horizon: int) -> DataFrame:
    """The recursive forecast of a rule instead of trees: the mean of the last four values."""
    return forecast.forecast(
        F.col("rolling_mean_4"), w.features, horizon, W.INTERVENTION_YEAR, W.INTERVENTION_WEEK
    )


@on_workspace
def moving_average_forecast_12wk(w):
    return _moving_average(w, 12)


@on_workspace
def moving_average_forecast_24wk(w):
    return _moving_average(w, 24)


@on_workspace
def short_history_forecast(w):
    """Recursion from three known weeks per series: lags and means that need more fall back."""
    newest = Window.partitionBy(*panel.SERIES).orderBy(F.desc(panel.DATE))
    known = w.features.withColumn("age", F.row_number().over(newest)).where("age <= 3").drop("age")
    rule = F.col("rolling_mean_8") * 0.5 + F.col("lag_4") * 0.5 + F.col("rolling_std_8") * 0.0
    return forecast.forecast(rule, known, 8, W.INTERVENTION_YEAR, W.INTERVENTION_WEEK)


@on_workspace
def moving_average_total(w):
    sums = forecast.forecast_total(_moving_average(w, 12))
    return sums.select(panel.DATE, F.round("forecast", DIGITS).alias("forecast"))


@on_workspace
def moving_average_band(w):
    bands = forecast.forecast_band(forecast.forecast_total(_moving_average(w, 12)))
    parts = ["forecast", "lower", "upper"]
    return bands.select(panel.DATE, *[F.round(c, DIGITS).alias(c) for c in parts])


@on_workspace
def gbt_importance_checks(w):
    """What holds for any fitted model: importances sum to one and every feature has a label."""
    table = model.feature_importance(w.model, w.spark, 9)
    return table.agg(
        F.round(F.sum("share"), 6).alias("total"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(F.col("gain") <= 0).alias("unused"),
    )


@on_workspace
def gbt_prediction_checks(w):
    """Per series: test rows, negative predictions, and rows the saved model scores differently."""
    path = new_path(w.spark, "model")
    model.save_model(w.spark, w.model, path)
    keys = [panel.DATE, *panel.SERIES]
    again = model.predict(model.load_model(w.spark, path), w.split[1])
    again = again.select(*keys, F.col(model.PREDICTION).alias("again"))
    y = F.col(model.PREDICTION)
    return (
        w.scored.join(again, keys)
        .groupBy(*panel.SERIES)
        .agg(
            F.count("*").alias("row_count"),
            F.count_if(y < 0).alias("negative"),
            F.count_if(y != F.col("again")).alias("different"),
        )
    )


@on_workspace
def recursive_backtest(w):
    return w.run_backtest()


@on_workspace
def backtest_steps(w):
    return evaluate.step_summary(w.backtest, "recursive_pred", digits=DIGITS)


@on_workspace
def forecast_12wk(w):
    return w.run_forecast()


@on_workspace
def forecast_total(w):
    return forecast.forecast_total(w.forecasts)


@on_workspace
def forecast_total_retail(w):
    return forecast.forecast_total(w.forecasts, platform="Retail")


@on_workspace
def forecast_band(w):
    return forecast.forecast_band(forecast.forecast_total(w.forecasts))
