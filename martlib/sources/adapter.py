"""Derives raw weekly sales from the order tables, so every query runs on given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.schemas import MONEY

# Fixed values of the mapping described in FIXTURES.md.
SHOPIFY_PRIORITIES = ["1-URGENT", "2-HIGH"]
SEGMENT_LETTERS = {"AUTOMOBILE": "C", "BUILDING": "C", "FURNITURE": "F", "HOUSEHOLD": "F"}
CUSTOMER_TYPES = {"F": "Existing", "O": "New", "P": "Guest"}


def _mapped(column: str, mapping: dict[str, str]):
    result = F.lit(None).cast("string")
    for key, value in mapping.items():
        result = F.when(F.col(column) == key, value).otherwise(result)
    return result


def weekly_sales_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation x region, grouped to the raw weekly grain.

    nation and region are small files, so Catalyst broadcasts them by size. The
    customer join is left to size too: broadcast when small, else sort-merge with
    AQE splitting a hot customer key. The final groupBy combines map-side down to
    at most one row per (week, region, platform, segment, type) and task.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_custkey",
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("o_orderpriority").isin(SHOPIFY_PRIORITIES), "Shopify")
        .otherwise("Retail")
        .alias("platform"),
        _mapped("o_orderstatus", CUSTOMER_TYPES).alias("customer_type"),
    )
    letter = _mapped("c_mktsegment", SEGMENT_LETTERS)
    number = (F.col("c_custkey") % 4 + 1).cast("string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.coalesce(F.concat(letter, number), F.lit("null")).alias("segment"),
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", F.col("n_regionkey").alias("r_regionkey")
    )
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        "r_regionkey", F.concat(F.lower("r_name"), F.lit(" ")).alias("region")
    )
    weekly = (
        orders.join(customers, "o_custkey")
        .join(nations, "n_nationkey")
        .join(regions, "r_regionkey")
        .withColumn("week", F.date_sub("order_date", F.weekday("order_date")))
        .groupBy("week", "region", "platform", "segment", "customer_type")
        .agg(F.count("*").alias("transactions"), F.sum("price").alias("sales"))
    )
    year = F.year("week")
    text = (
        F.when(year.between(1995, 1997), F.date_format("week", "d/M/yyyy"))
        .when(year == 1998, F.date_format("week", "yyyy-MM-dd"))
        .otherwise(F.date_format("week", "d/M/yy"))
    )
    return weekly.select(
        text.alias("week_date"),
        "region",
        "platform",
        "segment",
        "customer_type",
        "transactions",
        F.col("sales").cast(MONEY).alias("sales"),
    )
