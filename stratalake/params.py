"""Build parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from stratalake import contracts


@dataclass(frozen=True)
class BuildParams:
    """Everything a build can vary.

    as_of            date used by status rules and load stamps; None = current date
    dim_date_*       calendar range, both ends included
    strict           text that is not a number raises (True) or becomes NULL (False)
    inclusive        watermark keeps rows equal to the target maximum
    restart_keys     number every increment from 1 instead of continuing
    promote_integers land integers as doubles
    read_meta        fill the meta columns from the meta document instead of NULL
    tie_breakers     model -> landing columns that order rows of equal version; a model
                     that is not named uses a hash of the row
    number_rows      False leaves surrogate keys NULL, for builds that only need marts
    """

    as_of: dt.date | None = None
    dim_date_start: str = contracts.DIM_DATE_START
    dim_date_end: str = contracts.DIM_DATE_END
    environment: str = "dev"
    strict: bool = True
    inclusive: bool = False
    restart_keys: bool = False
    promote_integers: bool = False
    read_meta: bool = False
    number_rows: bool = True
    tie_breakers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def today(self) -> Column:
        return F.current_date() if self.as_of is None else F.lit(self.as_of)
