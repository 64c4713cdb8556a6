"""Date functions; the current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    """A fixed point in time without a zone, e.g. `2001-08-01 00:00:00`."""
    return F.lit(text).cast("timestamp_ntz")


def since(c: Column, as_of: Column, days: int) -> Column:
    """True from `days` days before `as_of` on, time of day included."""
    return c >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def days_before(as_of: Column, days: Column | int) -> Column:
    return F.date_sub(F.to_date(as_of), days)


def day_number(c: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(c)


def is_weekend(c: Column) -> Column:
    return F.dayofweek(c).isin(1, 7)


def is_late_weekday(c: Column) -> Column:
    """The Monday-based form of the weekend test (Monday = 0)."""
    return F.weekday(c) >= 5


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def month_day(c: Column) -> Column:
    return F.date_format(c, "MM-dd")


def month_day_number(c: Column) -> Column:
    """The same key as a number, cheaper to compute and to join on."""
    return F.month(c) * 100 + F.dayofmonth(c)


def date_text(c: Column) -> Column:
    return F.upper(F.date_format(c, "dd-MMM-yyyy"))


def date_time_text(c: Column) -> Column:
    return F.upper(F.date_format(c, "dd-MMM-yyyy HH:mm:ss"))


def short_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMM dd, yyyy"), F.lit("N/A"))


def slash_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MM/dd/yyyy"), F.lit("N/A"))


def clock_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "hh:mm a"), F.lit(""))


def parse_day(c: Column) -> Column:
    """Date from yyyy-MM-dd text; NULL when missing or malformed."""
    return F.try_to_date(c, "yyyy-MM-dd")


def full_years(born: Column, as_of: Column) -> Column:
    had_no_birthday = F.date_format(as_of, "MMdd") < F.date_format(born, "MMdd")
    return F.year(as_of) - F.year(born) - had_no_birthday.cast("int")
