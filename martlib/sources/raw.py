"""Raw weekly sales: CSV and SQL-dump readers, raw table and CSV writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions.cleaning import WHITE_SPACE, stripped
from martlib.schemas import RAW
from martlib.storage import path_exists

PLATFORM_MARKERS = "Retail|Shopify"

# Header row, doubled quotes inside quoted fields, blanks kept as they are.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

# Fixed pattern: one parenthesised tuple of seven quoted, non-empty fields.
DUMP_TUPLE = r"\(" + r",\s*".join(["'([^']+)'"] * len(RAW.fields)) + r"\)"


def typed_raw(text: DataFrame) -> DataFrame:
    """The raw columns from text columns of the same names.

    Whole numbers may be written with a fraction of zeros. A value that does not fit its
    type becomes null.
    """
    made = []
    for field in RAW.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.LongType):
            exact = stripped(value).try_cast("decimal(38,9)")
            value = F.when(exact == F.floor(exact), exact)
        elif isinstance(field.dataType, T.DecimalType):
            value = stripped(value)
        made.append(value.try_cast(field.dataType).alias(field.name))
    return text.select(*made)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; columns are taken by name, in any order, others are ignored."""
    text = spark.read.options(**CSV_OPTIONS).csv(path)
    names = {c.strip(WHITE_SPACE).lower(): c for c in text.columns}
    missing = [name for name in RAW.fieldNames() if name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return typed_raw(text.select(*[F.col(f"`{names[n]}`").alias(n) for n in RAW.fieldNames()]))


def read_raw_sqldump(spark: SparkSession, path: str) -> DataFrame:
    """Rows recovered from the INSERT tuples of a SQL dump; several tuples may share a line."""
    tuples = (
        spark.read.text(path)
        .select(F.trim("value").alias("line"))
        .filter(F.col("line").startswith("(") & F.col("line").rlike(PLATFORM_MARKERS))
        .select(F.explode(F.regexp_extract_all("line", F.lit(DUMP_TUPLE), F.lit(0))).alias("tuple"))
    )
    fields = [
        F.regexp_extract("tuple", DUMP_TUPLE, i + 1).alias(field.name)
        for i, field in enumerate(RAW.fields)
    ]
    rows = tuples.select(*fields).withColumn("region", F.upper("region"))
    return typed_raw(rows)


def resolve_raw(spark: SparkSession, csv_path: str, dump_path: str) -> DataFrame:
    """The CSV if it exists; else the dump, kept as CSV for the next run; else an error."""
    if not path_exists(spark, csv_path):
        if not path_exists(spark, dump_path):
            raise FileNotFoundError(f"neither {csv_path} nor {dump_path} exists")
        write_csv(read_raw_sqldump(spark, dump_path), csv_path)
    return read_raw_csv(spark, csv_path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def write_raw_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace the raw table with its fixed schema and return it as a table scan."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])
    typed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(RAW).parquet(path)
