"""Fixed schemas of the raw table and the star schema; nothing is inferred on read."""

from pyspark.sql import types as T

# Wide enough for a week of one market at 100 TB of orders; still stored in eight bytes.
MONEY = T.DecimalType(18, 2)

RAW = T.StructType(
    [
        T.StructField("week_date", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("transactions", T.LongType()),
        T.StructField("sales", MONEY),
    ]
)

DIM_REGION = T.StructType(
    [T.StructField("region_id", T.IntegerType()), T.StructField("region_name", T.StringType())]
)

DIM_PLATFORM = T.StructType(
    [T.StructField("platform_id", T.IntegerType()), T.StructField("platform_name", T.StringType())]
)

DIM_SEGMENT = T.StructType(
    [
        T.StructField("segment_id", T.IntegerType()),
        T.StructField("segment_code", T.StringType()),
        T.StructField("age_band", T.StringType()),
        T.StructField("demographic", T.StringType()),
    ]
)

# calendar_year comes last because it is the partition column of the fact files.
FACT = T.StructType(
    [
        T.StructField("sales_id", T.LongType()),
        T.StructField("week_date", T.DateType()),
        T.StructField("week_number", T.IntegerType()),
        T.StructField("month_number", T.IntegerType()),
        T.StructField("region_id", T.IntegerType()),
        T.StructField("platform_id", T.IntegerType()),
        T.StructField("segment_id", T.IntegerType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("transactions", T.LongType()),
        T.StructField("sales", MONEY),
        T.StructField("avg_transaction", MONEY),
        T.StructField("calendar_year", T.IntegerType()),
    ]
)

# Additive sums of the fact by week and keys.
SUMS = T.StructType(
    [f for f in FACT.fields if f.name not in ("sales_id", "transactions", "sales", "avg_transaction", "calendar_year")]
    + [
        T.StructField("transactions", T.LongType()),
        T.StructField("sales", T.DecimalType(28, 2)),
        T.StructField("row_count", T.LongType()),
        T.StructField("calendar_year", T.IntegerType()),
    ]
)

# Ids of the fact as bitmaps: bit p of bucket b stands for one id.
ID_BITS = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("calendar_year", T.IntegerType()),
    ]
)

FACT_COLUMNS = [
    "sales_id",
    "week_date",
    "week_number",
    "month_number",
    "calendar_year",
    "region_id",
    "platform_id",
    "segment_id",
    "customer_type",
    "transactions",
    "sales",
    "avg_transaction",
]

# A row handed to the append operator: names instead of surrogate keys.
NEW_ROW = T.StructType(
    [
        T.StructField("week_date", T.DateType()),
        T.StructField("region", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("transactions", T.LongType()),
        T.StructField("sales", MONEY),
    ]
)
