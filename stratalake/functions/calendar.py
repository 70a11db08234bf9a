"""Calendar attributes of a date column.

Names come from short literal arrays and keys from integer arithmetic: on a large
fact table this is several times cheaper than formatting each date as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# English day names from Sunday, month names from January.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _name(names: Sequence[str], position: Column) -> Column:
    """Name at a 1-based position."""
    listed = ", ".join(f"'{n}'" for n in names)
    return F.element_at(F.expr(f"array({listed})"), position)


def day_of_week(day: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(day) - 1).cast("int")


def date_attributes(day: Column) -> list[Column]:
    """The calendar columns. The week is the ISO week, the year is the calendar
    year: 2024-12-30 is week 1 of year 2024."""
    month = F.month(day)
    return [
        (F.year(day) * 10000 + month * 100 + F.dayofmonth(day)).alias("date_key"),
        day.alias("date_date"),
        F.dayofmonth(day).alias("day_of_month"),
        day_of_week(day).alias("day_of_week"),
        _name([n[:3] for n in DAYS], F.dayofweek(day)).alias("day_name_short"),
        _name(DAYS, F.dayofweek(day)).alias("day_name_long"),
        F.weekofyear(day).alias("week_of_year"),
        month.alias("month_num"),
        _name([n[:3] for n in MONTHS], month).alias("month_name_short"),
        _name(MONTHS, month).alias("month_name_long"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year_num"),
        (F.weekday(day) == 0).alias("is_week_start"),
        day_of_week(day).isin(0, 6).alias("is_weekend"),
        F.left(day.cast("string"), F.lit(7)).alias("year_month"),
    ]
