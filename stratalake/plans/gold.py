"""Gold models: the plant mart and counts by calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dm_plant(profile: DataFrame) -> DataFrame:
    """Plants per creation year and month, status, land provider and license status.
    Plants without a creation date form groups of their own."""
    return (
        profile.groupBy(
            F.year("PLANT_CREATED_AT").alias("year_num"),
            F.month("PLANT_CREATED_AT").alias("month_num"),
            "plant_status_ar",
            "LAND_PROVIDER_en",
            "LICENSE_STATUS",
        )
        .agg(F.count(F.lit(1)).alias("total_plant"))
        .orderBy("year_num", "month_num", F.desc("total_plant"))
    )


def count_by_calendar(
    facts: DataFrame, day_column: str, calendar: DataFrame, *attributes: str
) -> DataFrame:
    """Rows of ``facts`` per calendar attribute, joined on the day.

    Facts are counted per day first, so the join sees one row per day and map
    task, however many facts a day has.
    """
    per_day = facts.groupBy(F.col(day_column).cast("date").alias("date_date")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        per_day.join(calendar, "date_date")
        .groupBy(*attributes)
        .agg(F.sum("_n").alias("total_rows"))
    )
