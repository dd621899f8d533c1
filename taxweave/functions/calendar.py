"""Periods and calendar days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: Column, pattern: str) -> Column:
    """Day of a timestamp text; text that does not fit gives NULL."""
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def last_counted_day(as_of: dt.date) -> dt.date:
    """Last day that counts in the running year: the end of the last closed
    month, or in January the day itself."""
    if as_of.month == 1:
        return as_of
    return as_of.replace(day=1) - dt.timedelta(days=1)


def expected_months(year: int, as_of: dt.date) -> int:
    """How many months, from January on, a year should hold rows for."""
    if year != as_of.year:
        return 12
    return max(as_of.month - 1, 1)


def in_period(year: int, month: int | None = None) -> Column:
    hit = F.col("year") == year
    return hit if month is None else hit & (F.col("month") == month)
