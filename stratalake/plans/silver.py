"""Silver models: the plant profile and the calendar."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.contracts import (
    PROFILE_LICENSE_COLUMNS,
    PROFILE_PLANT_COLUMNS,
    PROFILE_RENAMED,
)
from stratalake.functions.calendar import date_attributes
from stratalake.operators.joins import left_join_spread
from stratalake.operators.spine import date_spine
from stratalake.params import BuildParams


def dim_plant_profile(
    plants: DataFrame, licenses: DataFrame, hot_licenses: Sequence[Any] = ()
) -> DataFrame:
    """One row per plant with the columns of its license; NULL without one. The plants of
    ``hot_licenses`` are spread over all reducers.

    ``LICENSE_ID`` must be unique in ``licenses`` (checked by the quality suite),
    else plants multiply.
    """
    ours = plants.select(*PROFILE_PLANT_COLUMNS, "LOAD_DATE").withColumnsRenamed(PROFILE_RENAMED)
    theirs = licenses.select("LICENSE_ID", *PROFILE_LICENSE_COLUMNS).withColumnsRenamed(
        PROFILE_LICENSE_COLUMNS
    )
    order = [PROFILE_RENAMED.get(c, c) for c in PROFILE_PLANT_COLUMNS]
    return left_join_spread(ours, theirs, "LICENSE_ID", "PLANT_ID", hot_licenses).select(
        *order, *PROFILE_LICENSE_COLUMNS.values(), "LOAD_DATE"
    )


def dim_date(bounds: DataFrame) -> DataFrame:
    """One row per calendar day of ``bounds`` (first_day, last_day)."""
    return date_spine(bounds).select(*date_attributes(F.col("date_date"))).orderBy("date_date")


def configured_bounds(spark: SparkSession, params: BuildParams) -> DataFrame:
    """Calendar range of the build parameters, as the bounds of ``dim_date``."""
    return spark.range(1).select(
        F.lit(params.dim_date_start).cast("date").alias("first_day"),
        F.lit(params.dim_date_end).cast("date").alias("last_day"),
    )
