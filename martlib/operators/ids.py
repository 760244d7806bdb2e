"""Gapless sequential ids for a table of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlib.storage import new_path

TIE = "_tie"


def mark_ties(df: DataFrame) -> DataFrame:
    """Tag rows of a table scan, so a pile of identical rows can spread over many tasks.

    The tag separates only rows that are equal in every ordering column, and a scan
    gives it the same way on every attempt.
    """
    return df.withColumn(TIE, F.monotonically_increasing_id())


def number_rows(
    df: DataFrame,
    order_by: list[str],
    id_column: str,
    start: int | Callable[[int], int] = 0,
    partitions: int | None = None,
) -> tuple[DataFrame, int, str]:
    """(``df`` with ids start+1.. in ``order_by`` order, last id, path of the staged rows).

    Pass 1 range-partitions and sorts the rows and writes them to the shared folder.
    Pass 2 reads them back: a row's id is the number of rows in the files before its
    own plus its position in that file. No task ever holds one key's rows as a group,
    ids cannot change after the staged files exist, and what is joined has one row per
    staged file. The caller may remove the staged path once the result is stored.
    ``start`` may be a function of the number of rows, which reserves ids once it is known.
    ``partitions`` sizes the range shuffle; None leaves it to the session and AQE.
    """
    spark = df.sparkSession
    schema_df = df.drop(TIE)
    keys = order_by + [TIE] if TIE in df.columns else order_by
    path = new_path(spark, "numbering")
    sized = [partitions] if partitions else []
    ranged = df.repartitionByRange(*sized, *keys)
    ranged.sortWithinPartitions(*keys).drop(TIE).write.parquet(path)

    scan = spark.read.schema(schema_df.schema).parquet(path)
    staged = scan.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    # part-00012-... : the task number is the position in range order.
    task = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(task, "_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy("_file").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    count = scan.count()
    if callable(start):
        start = start(count)
    numbered = staged.join(offsets, "_file").select(
        (F.col("_before") + F.col("_row") + F.lit(start + 1)).cast("long").alias(id_column),
        *schema_df.columns,
    )
    return numbered, start + count, path
