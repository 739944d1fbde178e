"""Dates kept as ISO strings, and windows over them.  The day of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_date(value: Column) -> Column:
    """``YYYY-MM-DD`` if it is a day of the calendar, else null."""
    text = F.regexp_extract(F.trim(value), r"^(\d{4}-\d{2}-\d{2})$", 1)
    day = F.try_to_timestamp(F.when(text != "", text), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, text)


def minute(value: Column) -> Column:
    """``YYYY-MM-DDTHH:MM`` of a local time with a blank or T between, else empty."""
    text = F.left(F.replace(F.trim(value), F.lit(" "), F.lit("T")), F.lit(16))
    read = F.try_to_timestamp(F.when(F.length(text) == 16, text), F.lit("yyyy-MM-dd'T'HH:mm"))
    return F.when(read.isNotNull(), text).otherwise("")


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", day).cast("date")


def relative_week(day: Column, today: Column) -> Column:
    """Weeks between a day and the week of ``today``; 0 in the same week."""
    return F.floor(F.datediff(week_start(day), week_start(today)) / 7)


def recent_years(as_of: int, count: int) -> tuple[int, int]:
    """First and last year of the window of ``count`` years that ends in ``as_of``."""
    return as_of - count + 1, as_of


def in_years(year: Column, as_of: int, count: int) -> Column:
    first, last = recent_years(as_of, count)
    return F.coalesce(year.between(first, last), F.lit(False))
