"""Exact order statistics of columns of any size: count buckets, then look into one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
# Values that are sorted at once, in one buffer.
ENOUGH = 100_000


def value_at_rank(values: DataFrame, rank: int, low: float, high: float, count: int, enough: int = ENOUGH) -> float:
    """The ``rank``-th smallest (from 1) of a one-column frame ``v`` without nulls.

    Each round splits the range that holds the rank into buckets of equal width, counts them with
    map-side combine and goes on with the bucket of the rank, from its least to its largest value.
    """
    below = 0
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        if count <= enough:
            ordered = F.sort_array(F.collect_list("v"))
            return inside.agg(F.get(ordered, F.lit(rank - below - 1)).alias("v")).first()[0]
        # Halves before the difference, which can be larger than any double.
        width = (high / 2 - low / 2) / BUCKETS
        place = F.floor((F.col("v") / 2 - low / 2) / width) if width > 0 else (F.col("v") == high).cast("long")
        found = (
            inside.groupBy(F.least(place, F.lit(BUCKETS - 1)).alias("place"))
            .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("place")
            .collect()  # at most BUCKETS rows
        )
        for bucket in found:
            if below + bucket.n >= rank:
                low, high, count = bucket.low, bucket.high, bucket.n
                break
            below += bucket.n
    return low


def exact_median(df: DataFrame, column: str, enough: int = ENOUGH) -> float | None:
    """Median of a column in bounded memory; null and NaN are left out, None when nothing is left."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    middle = [value_at_rank(values, r, low, high, n, enough) for r in sorted({(n + 1) // 2, n // 2 + 1})]
    return sum(middle) / len(middle)
