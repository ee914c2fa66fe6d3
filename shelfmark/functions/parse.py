"""Parsing of raw scalar fields. Every cast is a ``try_cast``: dirty input gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The first and last millisecond of the years 1 to 9999.
FIRST_MS = -62135596800000
LAST_MS = 253402300799999


def parse_price(raw: Column) -> Column:
    """First unsigned number after dropping ',' and '$'; "$10 - $20" gives 10."""
    number = F.regexp_extract(F.regexp_replace(raw, "[,$]", ""), r"\d+(?:\.\d+)?", 0)
    return F.nullif(number, F.lit("")).try_cast("decimal(10,2)")


# A date needs at least year, month and day; no number begins like that.
_DATE = r"^\d{4}-\d{2}-\d{2}"


def epoch_ms(raw: Column) -> Column:
    """The raw timestamp as a whole number of milliseconds, null for any other text.

    Dates are not tried, as each failed cast to a decimal makes and catches an exception.
    """
    return F.when(~raw.rlike(_DATE), raw.try_cast("decimal(24,6)").try_cast("bigint"))


def parse_time(raw: Column) -> Column:
    """Epoch milliseconds, else ISO-8601 (``Z`` accepted), else null."""
    ms = epoch_ms(raw)
    in_range = F.when(ms.between(FIRST_MS, LAST_MS), ms)
    iso = F.when(raw.rlike(_DATE), F.try_to_timestamp(raw))
    return F.coalesce(F.timestamp_millis(in_range), iso)


def flag(raw: Column) -> Column:
    return F.coalesce(F.lower(raw).try_cast("boolean"), F.lit(False))


def whole(raw: Column, default: int = 0) -> Column:
    return F.coalesce(raw.try_cast("decimal(20,4)").try_cast("int"), F.lit(default))
