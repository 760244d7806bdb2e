"""Table maintenance: validated appends and deletes on a stored star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.functions import cleaning as C
from martlib.operators import publish
from martlib.operators.ids import mark_ties, number_rows
from martlib.operators.star import (
    FACT_TABLE,
    ID_ORDER,
    ID_RANGES,
    Star,
    check_batch,
    read_high_water,
    read_star,
    resolve_keys,
    stage_ids,
    stage_sums,
    taken_ids,
)
from martlib.schemas import FACT
from martlib.storage import remove_path, write_through

# What an input form accepts.
CUSTOMER_TYPES = ["New", "Existing", "Guest"]
LEAST_TRANSACTIONS = 1
LEAST_SALES = 1


def validate_new_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``) by the input rules."""
    reason = (
        F.when(F.col("week_date").isNull(), "week_date")
        .when(F.coalesce(F.col("transactions"), F.lit(0)) < LEAST_TRANSACTIONS, "transactions")
        .when(F.coalesce(F.col("sales"), F.lit(0)) < LEAST_SALES, "sales")
        .when(~F.coalesce(F.col("customer_type").isin(CUSTOMER_TYPES), F.lit(False)), "customer_type")
    )
    marked = rows.withColumn("reject_reason", reason)
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def derive_new_facts(
    star: Star, rows: DataFrame, week_rule: str = "monday_w1"
) -> tuple[DataFrame, DataFrame]:
    """(rows with ids of all three dimensions and derived columns, rejected rows).

    A name without a dimension row is a reject, never a new dimension member.
    """
    valid, rejected = validate_new_rows(rows)
    d = F.col("week_date")
    derived = valid.withColumnRenamed("segment", "segment_code").withColumns(
        {
            "week_number": C.week_number(d, week_rule),
            "month_number": C.month_number(d),
            "calendar_year": C.calendar_year(d),
            "avg_transaction": C.avg_transaction(F.col("sales"), F.col("transactions")),
        }
    )
    keyed = resolve_keys(derived, star, "left")
    reason = (
        F.when(F.col("region_id").isNull(), "unknown region")
        .when(F.col("platform_id").isNull(), "unknown platform")
        .when(F.col("segment_id").isNull(), "unknown segment")
    )
    marked = keyed.withColumn("reject_reason", reason)
    unmatched = marked.filter(F.col("reject_reason").isNotNull())
    columns = ["week_date", "region", "platform", "segment", "customer_type"]
    columns += ["transactions", "sales", "reject_reason"]
    rejects = rejected.select(*columns).unionByName(
        unmatched.withColumnRenamed("segment_code", "segment").select(*columns)
    )
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), rejects


def new_facts(
    star: Star, rows: DataFrame, last_id: int | Callable[[int], int]
) -> tuple[DataFrame, DataFrame, int, str]:
    """(fact rows numbered after ``last_id``, rejects, new last id, staged path).

    ``last_id`` may be a function that reserves ids for the number of rows it is given.
    """
    matched, rejects = derive_new_facts(star, mark_ties(rows))
    numbered, top, staged = number_rows(matched, ID_ORDER, "sales_id", start=last_id)
    return numbered.select(*FACT.fieldNames()), rejects, top, staged


def append_sales(spark: SparkSession, path: str, rows: DataFrame) -> tuple[int, DataFrame]:
    """Append a batch to the stored fact. Returns (rows added, rejects).

    The batch reserves its ids before its rows are written, so any number of writers can append
    at once, and a job that dies leaves a gap in the ids, never a reused one. Readers see all
    of the batch or nothing.
    """
    table, reserved, seen = f"{path}/{FACT_TABLE}", [], []

    def reserve(count: int) -> int:
        reserved.append(count)
        seen.extend(publish.live(spark, table)[1])
        return publish.reserve_ids(spark, f"{path}/{ID_RANGES}", count) if count else 0

    facts, rejects, _, staged = new_facts(read_star(spark, path), rows, reserve)
    # Judged before the append, so later changes of the caller's rows do not show.
    rejects = write_through(rejects, "append-rejects")
    if reserved[0]:
        _publish_rows(spark, table, facts, seen)
    remove_path(spark, staged)
    return reserved[0], rejects


def _publish_rows(spark: SparkSession, table: str, facts: DataFrame, seen: list[str]) -> None:
    """Commits new rows whose ids are none of those in the folders ``seen``.

    What other writers have committed since is looked at before the commit, in their id
    bitmaps only, so two writers never publish the same id.
    """
    folders = publish.stage(facts, table, "calendar_year")
    rows = publish.read_folders(spark, table, FACT, folders)
    folders += stage_sums(rows, table) + stage_ids(rows, table)
    known = set(seen)

    def change(now: list[str]) -> list[str] | None:
        later = [f for f in now if f.startswith("ids=") and f not in known]
        if later and not taken_ids(spark, table, rows, later).isEmpty():
            return None
        known.update(later)
        return now + folders

    if not publish.commit(spark, table, change):
        raise ValueError("another writer has published some of these ids")


def append_facts(spark: SparkSession, path: str, facts: DataFrame) -> int:
    """Append rows that carry their ids and keys, such as deleted rows put back; returns how many.

    The batch is checked by itself (see ``check_batch``) and refused as a whole when it breaks a
    constraint. Later appends get higher ids than any of these.
    """
    table = f"{path}/{FACT_TABLE}"
    rows = write_through(facts.select(*FACT.fieldNames()), "append-facts")
    seen = publish.live(spark, table)[1]
    broken = check_batch(spark, path, rows, seen).where("violations > 0").collect()
    if broken:
        raise ValueError(f"constraints broken: {[(r.rule, r.violations) for r in broken]}")
    size = rows.agg(F.count("*").alias("n"), F.max("sales_id").alias("high")).first()
    if not size.n:
        return 0
    while (last := read_high_water(spark, path)) < size.high:
        publish.reserve_ids(spark, f"{path}/{ID_RANGES}", size.high - last)
    _publish_rows(spark, table, rows, seen)
    return size.n


def without_ids(fact: DataFrame, ids: DataFrame) -> DataFrame:
    """Fact rows whose id is not listed."""
    return fact.join(ids.select("sales_id"), "sales_id", "left_anti")


def _of_years(folders: list[str], years: list[int]) -> list[str]:
    ends = tuple(f"/calendar_year={y}" for y in years)
    return [f for f in folders if f.startswith(("batch=", "ids=")) and f.endswith(ends)]


def delete_sales(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete by id list; returns the number of rows removed.

    Only the years that hold a listed id are rewritten, once and in one job: their survivors
    go to new folders, which one commit puts in place of the old ones. When another writer has
    changed one of these years meanwhile, the delete starts again from that writer's table.
    """
    table = f"{path}/{FACT_TABLE}"
    ids = ids.select("sales_id").distinct()
    listed = ids.agg(
        F.count("*").alias("n"), F.min("sales_id").alias("low"), F.max("sales_id").alias("high")
    ).first()
    for _ in range(publish.ATTEMPTS):
        _, before = publish.live(spark, table)
        fact = publish.read(spark, table, FACT)
        # Ids follow the file order, so the id range skips row groups.
        in_range = fact.filter(F.col("sales_id").between(listed.low, listed.high))
        matches = in_range.join(ids, "sales_id", "left_semi")
        hit = matches.groupBy("calendar_year").agg(F.count("*").alias("n")).collect() if listed.n else []
        if not hit:
            return 0
        years = [row.calendar_year for row in hit]  # one entry per calendar year
        touched = fact.filter(F.col("calendar_year").isin(years))
        left = without_ids(touched, ids).repartitionByRange("calendar_year", "sales_id")
        folders = publish.stage(left.sortWithinPartitions("calendar_year", "sales_id"), table, "calendar_year")
        folders += stage_ids(publish.read_folders(spark, table, FACT, folders), table)
        folders += stage_sums(matches, table, -1)
        replaced = sorted(_of_years(before, years))

        def change(now: list[str]) -> list[str] | None:
            if sorted(_of_years(now, years)) != replaced:
                return None
            return [f for f in now if f not in replaced] + folders

        if publish.commit(spark, table, change):
            return sum(row.n for row in hit)
    raise RuntimeError("other writers kept changing the same years")
