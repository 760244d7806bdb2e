"""Star schema: dimensions, key resolution, fact build, analytical view, load checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib import schemas as S
from martlib.operators.clean import clean_weekly_sales, split_rejects
from martlib.operators import publish
from martlib.operators.ids import TIE, mark_ties, number_rows
from martlib.storage import partitions_for, remove_path, write_through

# Ids follow the week, then the natural key.
ID_ORDER = [
    "week_date",
    "region",
    "platform",
    "segment_code",
    "customer_type",
    "transactions",
    "sales",
]

DIMENSIONS = ["dim_region", "dim_platform", "dim_segment"]
FACT_TABLE = "fact_weekly_sales"
ID_RANGES = "id_ranges"
TABLES = [*DIMENSIONS, FACT_TABLE]
FACT_KEYS = ["region_id", "platform_id", "segment_id"]
SUM_KEYS = ["week_date", "week_number", "month_number", "calendar_year", *FACT_KEYS, "customer_type"]


@dataclass(frozen=True)
class Star:
    """The three dimensions and the fact, as lazy DataFrames."""

    dim_region: DataFrame
    dim_platform: DataFrame
    dim_segment: DataFrame
    fact: DataFrame

    def dims(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in DIMENSIONS}

    def table(self, name: str) -> DataFrame:
        return self.fact if name == "fact_weekly_sales" else getattr(self, name)


def _numbered_dim(keys: DataFrame, id_column: str, order_by: str) -> DataFrame:
    numbered, _, _ = number_rows(keys, [order_by], id_column)
    return numbered.withColumn(id_column, F.col(id_column).cast("int"))


def build_dim(clean: DataFrame, column: str) -> DataFrame:
    """Sorted distinct names of ``region`` or ``platform`` with a surrogate id."""
    names = clean.select(F.col(column).alias(f"{column}_name")).distinct()
    return _numbered_dim(names, f"{column}_id", f"{column}_name")


def build_dim_segment(clean: DataFrame) -> DataFrame:
    keys = clean.select("segment_code", "age_band", "demographic").distinct()
    return _numbered_dim(keys, "segment_id", "segment_code")


def natural_keys(clean: DataFrame) -> DataFrame:
    """The distinct key combinations, written once: all dimensions come from one scan."""
    keys = clean.select("region", "platform", "segment_code", "age_band", "demographic")
    return write_through(keys.distinct(), "natural-keys")


def resolve_keys(clean: DataFrame, star: Star, how: str = "inner") -> DataFrame:
    """Natural keys to surrogate ids. Dimension tables are broadcast by their file size.

    ``how="left"`` keeps rows without a match, with a null id.
    """
    return (
        clean.join(star.dim_region.withColumnRenamed("region_name", "region"), "region", how)
        .join(star.dim_platform.withColumnRenamed("platform_name", "platform"), "platform", how)
        .join(star.dim_segment.select("segment_id", "segment_code"), "segment_code", how)
    )


def build_fact(numbered: DataFrame, star: Star) -> DataFrame:
    """Fact rows from clean rows that already carry ``sales_id``: broadcast joins only."""
    return resolve_keys(numbered, star).select(*S.FACT.fieldNames())


def write_star(star: Star, path: str, last_id: int) -> None:
    """Drop and rebuild the four tables under ``path``, and set the id high-water mark."""
    for name, df in star.dims().items():
        _write_dim(df, path, name)
    _write_fact(star.fact, path, last_id)


def _write_dim(df: DataFrame, path: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def _write_fact(fact: DataFrame, path: str, last_id: int) -> None:
    """Publishes a whole new fact; its ids take the place of all earlier ones."""
    spark, table = fact.sparkSession, f"{path}/{FACT_TABLE}"
    folders = publish.stage(fact, table, "calendar_year")
    staged = publish.read_folders(spark, table, S.FACT, folders)
    folders += stage_sums(staged, table) + stage_ids(staged, table)
    publish.reserve_ids(spark, f"{path}/{ID_RANGES}", last_id, after=0)
    publish.commit(spark, table, lambda _: folders)


def stage_sums(rows: DataFrame, table: str, sign: int = 1) -> list[str]:
    """Additive sums of added or (sign -1) removed fact rows by week and keys, not yet published."""
    sums = rows.groupBy(*SUM_KEYS).agg(
        *[(F.sum(m) * sign).cast(S.SUMS[m].dataType).alias(m) for m in ("transactions", "sales")],
        (F.count("*") * sign).alias("row_count"),
    )
    return publish.stage(sums, table, "calendar_year", "sums")


def stage_ids(rows: DataFrame, table: str) -> list[str]:
    """The ids of fact rows as bitmaps, not yet published: about one bit per id, as ids are dense."""
    bits = (
        rows.where("sales_id is not null")
        .groupBy("calendar_year", F.bitmap_bucket_number("sales_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("sales_id")).alias("bits"))
    )
    # Sorted, so a range of buckets skips pages of the files.
    return publish.stage(bits.sortWithinPartitions("calendar_year", "bucket"), table, "calendar_year", "ids")


def taken_ids(spark: SparkSession, table: str, ids: DataFrame, folders: list[str]) -> DataFrame:
    """Distinct ids of a batch that the stored fact has, by the bitmaps in ``folders``.

    Only buckets in the batch's id range are read, and the fact is not scanned at all. A batch
    with fresh ids finds no bucket.
    """
    place = F.bitmap_bit_position("sales_id")
    wanted = ids.where("sales_id is not null").select(
        "sales_id", F.bitmap_bucket_number("sales_id").alias("bucket"), place.alias("place")
    ).distinct()
    span = wanted.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    folders = [f for f in folders if f.startswith("ids=")]
    stored = publish.read_folders(spark, table, S.ID_BITS, folders).where(F.col("bucket").between(span.low, span.high))
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(place div 8 as int) + 1"), F.lit(1))), 16, 10)
    is_set = F.expr("(shiftright(byte, cast(place % 8 as int)) & 1) = 1")
    found = wanted.join(stored.select("bucket", "bits"), "bucket").withColumn("byte", byte.cast("int"))
    return found.where(is_set).select("sales_id").distinct()


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """Sums of the stored fact by week and keys, without a scan of it.

    They change in the same commit as the fact, by the sums of what it adds or removes.
    """
    parts = publish.read(spark, f"{path}/{FACT_TABLE}", S.SUMS, "sums")
    sums = parts.groupBy(*SUM_KEYS).agg(
        *[F.sum(m).cast(S.SUMS[m].dataType).alias(m) for m in ("transactions", "sales", "row_count")]
    )
    return sums.where("row_count > 0")


def read_high_water(spark: SparkSession, path: str) -> int:
    """The highest id ever given: ids are never reused after deletes."""
    return publish.last_id(spark, f"{path}/{ID_RANGES}")


def read_star(spark: SparkSession, path: str) -> Star:
    def table(name, schema):
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return Star(
        dim_region=table("dim_region", S.DIM_REGION),
        dim_platform=table("dim_platform", S.DIM_PLATFORM),
        dim_segment=table("dim_segment", S.DIM_SEGMENT),
        fact=publish.read(spark, f"{path}/{FACT_TABLE}", S.FACT),
    )


def build_star(raw: DataFrame, path: str, week_rule: str = "monday_w1") -> Star:
    """Whole ETL: clean, reject, dimensions, fact, tables under ``path``.

    ``raw`` should be a table scan (see ``write_raw_table``). Rejected rows are kept
    in ``path/rejects``.
    """
    spark = raw.sparkSession
    accepted, rejected = split_rejects(clean_weekly_sales(mark_ties(raw), week_rule))
    rejected.write.mode("overwrite").parquet(f"{path}/rejects")
    numbered, last_id, staged = number_rows(
        accepted, ID_ORDER, "sales_id", partitions=partitions_for(raw)
    )
    keys = natural_keys(spark.read.schema(accepted.drop(TIE).schema).parquet(staged))
    dims = Star(
        dim_region=_write_dim(build_dim(keys, "region"), path, "dim_region"),
        dim_platform=_write_dim(build_dim(keys, "platform"), path, "dim_platform"),
        dim_segment=_write_dim(build_dim_segment(keys), path, "dim_segment"),
        fact=numbered,
    )
    _write_fact(build_fact(numbered, dims), path, last_id)
    remove_path(spark, staged)
    return read_star(spark, path)


def mart(star: Star) -> DataFrame:
    """The analytical view: the fact with names in place of ids."""
    return (
        star.fact.join(star.dim_region, "region_id")
        .join(star.dim_platform, "platform_id")
        .join(star.dim_segment, "segment_id")
        .select(
            "sales_id",
            "week_date",
            "week_number",
            "month_number",
            "calendar_year",
            F.col("region_name").alias("region"),
            F.col("platform_name").alias("platform"),
            F.col("segment_code").alias("segment"),
            "age_band",
            "demographic",
            "customer_type",
            "transactions",
            "sales",
            "avg_transaction",
        )
    )


def register_views(star: Star) -> None:
    """Session views for SQL users: the four tables and ``clean_weekly_sales``."""
    for name in TABLES:
        star.table(name).createOrReplaceTempView(name)
    mart(star).createOrReplaceTempView("clean_weekly_sales")


def verify_counts(star: Star) -> DataFrame:
    """Row counts of the four tables and the view; the view's joins see one row per key set."""
    counted = {name: star.table(name).agg(F.count("*").alias("row_count")) for name in TABLES}
    view = star.fact.groupBy(*FACT_KEYS).agg(F.count("*").alias("n"))
    for dim in star.dims().values():
        view = view.join(dim, dim.columns[0])
    counted["clean_weekly_sales"] = view.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
    named = [df.select(F.lit(name).alias("table_name"), "row_count") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, named)


def _duplicates(df: DataFrame, column: str) -> DataFrame:
    repeated = df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias("violations"))


def _null_cells(df: DataFrame):
    per_row = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    return F.sum(per_row)


def _total(df: DataFrame, value) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).alias("violations"))


def _fact_checks(fact: DataFrame, star: Star, repeated: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """Checks of fact rows; ``repeated`` has the count of ids that are not unique."""
    fact_keys = write_through(
        fact.groupBy(*FACT_KEYS).agg(F.count("*").alias("n"), _null_cells(fact).alias("null_cells")),
        "fact-keys",
    )
    checks = {
        (FACT_TABLE, "not_null"): _total(fact_keys, F.sum("null_cells")),
        (FACT_TABLE, "unique_sales_id"): repeated,
    }
    for dim in star.dims().values():
        key = dim.columns[0]
        orphans = fact_keys.join(dim, key, "left_anti")
        checks[FACT_TABLE, f"foreign_key_{key}"] = _total(orphans, F.sum("n"))
    return checks


def _as_rows(checks: dict[tuple[str, str], DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            found.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations")
            for (table, rule), found in checks.items()
        ],
    )


def check_batch(spark: SparkSession, path: str, facts: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """What fact rows would add to the violations of a stored star that has none.

    Equals ``check_constraints`` of stored and new rows together, but reads the new rows, the
    dimensions and some bitmaps of stored ids only. ``folders`` are those of the version to
    check against, the newest by default.
    """
    table = f"{path}/{FACT_TABLE}"
    folders = publish.live(spark, table)[1] if folders is None else folders
    own = facts.groupBy("sales_id").agg(F.count("*").alias("n")).where("n > 1").select("sales_id")
    repeated = own.unionByName(taken_ids(spark, table, facts, folders)).distinct()
    return _as_rows(_fact_checks(facts, read_star(spark, path), repeated.agg(F.count("*").alias("violations"))))


def check_constraints(star: Star) -> DataFrame:
    """The declared constraints as counts of violations: unique, not null, foreign keys.

    One scan reduces the fact to a row per key combination with its row and null counts;
    that small table is written once and answers every fact check but id uniqueness.
    """
    checks = _fact_checks(star.fact, star, _duplicates(star.fact, "sales_id"))
    for name, dim in star.dims().items():
        key, natural = dim.columns[:2]
        checks[name, "not_null"] = _total(dim, _null_cells(dim))
        for column in (key, natural):
            checks[name, f"unique_{column}"] = _duplicates(dim, column)
    return _as_rows(checks)
