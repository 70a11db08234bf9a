"""Day spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def date_bounds(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row (first_day, last_day) over date-like columns of several tables.

    Each table is reduced to its own two dates before the union.
    """
    parts = [
        df.agg(
            F.min(c).cast("date").alias("first_day"), F.max(c).cast("date").alias("last_day")
        )
        for df, c in columns
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def date_spine(bounds: DataFrame) -> DataFrame:
    """(n, date_date) for every day of ``bounds`` (first_day, last_day), both ends
    included. One sequence, no cross join."""
    return bounds.select(
        F.posexplode(F.sequence("first_day", "last_day")).alias("n", "date_date")
    )
