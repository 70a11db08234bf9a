"""Casts from landed values to model types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _convert(value: Column, to: str, strict: bool) -> Column:
    return value.cast(to) if strict else value.try_cast(to)


def blank_to_number(df: DataFrame, name: str, to: str, strict: bool = True) -> Column:
    """Number from a landed column where text of only spaces means NULL."""
    value = F.col(name)
    if _numeric(df, name):
        return _convert(value, to, strict)
    return F.when(F.trim(value) != "", _convert(value, to, strict))


def empty_to_number(df: DataFrame, name: str, to: str, strict: bool = True) -> Column:
    """Number from a landed column where only the empty text means NULL."""
    value = F.col(name)
    if _numeric(df, name):
        return _convert(value, to, strict)
    return _convert(F.nullif(value, F.lit("")), to, strict)


def to_timestamp(df: DataFrame, name: str) -> Column:
    """Zone-less timestamp. A column that already is one stays a bare reference,
    so that a filter on it still reaches the file scan."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return value
    return value.cast("timestamp_ntz")


def typed_nulls(types: Mapping[str, str]) -> list[Column]:
    """Placeholder columns: NULL of a declared type, so the shape is stable."""
    return [F.expr(f"CAST(NULL AS {t}) AS `{name}`") for name, t in types.items()]


def promote_integers(df: DataFrame) -> DataFrame:
    """Every integer column as double; all other columns unchanged."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.IntegralType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
