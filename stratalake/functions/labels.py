"""Code-to-label mapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from stratalake.contracts import PROVIDER_LABELS, STATE_LABELS


def sql_text(value: str) -> str:
    """A text as SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def label(code: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code; NULL for an unknown or NULL code.

    The map is a literal, folded at planning: no join and no UDF.
    """
    pairs = ", ".join(sql_text(x) for pair in labels.items() for x in pair)
    return F.expr(f"map({pairs})")[code]


def state_label(code: Column) -> Column:
    return label(code, STATE_LABELS)


def provider_label(code: Column) -> Column:
    return label(code, PROVIDER_LABELS)
