"""Instants, local days and calendar buckets as column expressions.

Instants are ISO 8601 text with an offset; they are compared as microseconds since the epoch, so
nothing depends on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: An ISO instant with its offset.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"
UNIT_US = {"hours": 3_600_000_000, "days": DAY_US, "weeks": 7 * DAY_US}


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch of an ISO instant; null where it is malformed or has no offset."""
    return F.when(text.rlike(ZONED), F.unix_micros(text.try_cast("timestamp")))


def utc_day_number(us: Column) -> Column:
    """Days since the epoch; the remainder goes first, as a double quotient loses microseconds."""
    return ((us - F.pmod(us, F.lit(DAY_US))) / F.lit(DAY_US)).cast("int")


def utc_date(us: Column) -> Column:
    """The UTC calendar day of an instant."""
    return F.date_from_unix_date(utc_day_number(us))


def utc_day_text(us: Column) -> Column:
    return utc_date(us).cast("string")


def utc_month_text(us: Column) -> Column:
    return F.substring(utc_date(us).cast("string"), 1, 7)


def bucket(date: Column, size: str) -> Column:
    """Label of the day, Monday week (week 00 before the year's first Monday), month or year."""
    if size == "day":
        return F.date_format(date, "yyyy-MM-dd")
    if size == "month":
        return F.date_format(date, "yyyy-MM")
    if size == "year":
        return F.date_format(date, "yyyy")
    if size == "week":
        week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)
        return F.format_string("%04d-W%02d", F.year(date), week.cast("int"))
    raise ValueError(f"unknown bucket {size!r}")
