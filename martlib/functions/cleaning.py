"""Column expressions that turn raw text into clean values. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlib.schemas import MONEY

UNKNOWN = "unknown"

# Fixed value: what counts as white space at the ends of a text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# Texts that mean "no segment given".
MISSING_SEGMENT_TEXTS = ["null", "none", "", "nan"]

# Last character of a segment code -> age band.
AGE_BANDS = {"1": "Young Adults", "2": "Middle Aged", "3": "Retirees", "4": "Retirees"}

# First character of a segment code -> demographic.
DEMOGRAPHICS = {"C": "Couples", "F": "Families"}

# Two-digit years 69..99 belong to the 1900s, 00..68 to the 2000s.
PIVOT_YEAR = 2069


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def parse_week_date(c: Column) -> Column:
    """Date from day/month/2-digit-year, ISO or day/month/4-digit-year text; else null."""
    text = stripped(c)
    short = F.try_to_date(text, "d/M/yy")
    short = F.when(F.year(short) >= PIVOT_YEAR, F.add_months(short, -1200)).otherwise(short)
    return (
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), short)
        .when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy"))
    )


def week_number(d: Column, rule: str = "monday_w1") -> Column:
    """Week of the year.

    ``monday_w1``: weeks start on Monday, days before the first Monday are week 1.
    ``iso``: ISO-8601 week.
    """
    if rule == "iso":
        return F.weekofyear(d)
    if rule != "monday_w1":
        raise ValueError(f"unknown week rule {rule!r}")
    return (F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7) + 1).cast("int")


def month_number(d: Column) -> Column:
    return F.month(d)


def calendar_year(d: Column) -> Column:
    return F.year(d)


def quarter(d: Column) -> Column:
    return F.quarter(d)


def segment_code(c: Column) -> Column:
    """Upper-cased trimmed code; null and null-like texts become ``unknown``."""
    text = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(MISSING_SEGMENT_TEXTS), UNKNOWN).otherwise(F.upper(text))


def _lookup(key: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(UNKNOWN))


def age_band(code: Column) -> Column:
    return _lookup(F.right(code, F.lit(1)), AGE_BANDS)


def demographic(code: Column) -> Column:
    return _lookup(F.left(code, F.lit(1)), DEMOGRAPHICS)


def upper_name(c: Column) -> Column:
    return F.upper(stripped(c))


def plain_name(c: Column) -> Column:
    return stripped(c)


def avg_transaction(sales: Column, transactions: Column) -> Column:
    """Sales per transaction to two decimals, half-up on exact decimals; 0 without transactions.

    A quotient by one or more is no larger than the sales, so it fits their type.
    """
    per_unit = F.round(F.try_divide(sales, transactions.cast("decimal(20,0)")), 2)
    return F.when(transactions > 0, per_unit.cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
