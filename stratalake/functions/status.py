"""License status rules at a given day. Their labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def license_cycle(today: Column) -> Column:
    """Life-cycle label: the first rule that holds."""
    expiry = F.col("expires_at").cast("date")
    return (
        F.when(F.col("deleted_at").isNotNull(), "Deleted")
        .when(F.col("canceled_at").isNotNull(), "Canceled")
        .when(F.col("suspended_at").isNotNull(), "Suspended")
        .when(expiry < today, "Expired")
        .when(F.col("issue_date").isNotNull() & (expiry >= today), "Active")
        .otherwise("Unknown")
    )


def license_status(today: Column) -> Column:
    """Active until the expiry day; a license without expiry counts as expired."""
    return F.when(F.col("expires_at").cast("date") >= today, "Active").otherwise("Expired")
