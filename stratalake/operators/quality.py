"""Data-quality checks: a check is a query whose rows are failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from stratalake.functions.labels import sql_text

NOT_NULL = "not_null"
UNIQUE = "unique"


@dataclass(frozen=True)
class Check:
    """``test`` is not_null or unique, on one column of a named table."""

    table: str
    column: str
    test: str


class QualityError(Exception):
    """A suite had failing checks."""


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def duplicate_values(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once, with their row count; NULLs are ignored.
    The count is combined before the shuffle, so a hot value costs one row per task."""
    return (
        df.dropna(subset=list(columns))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .filter("n_records > 1")
    )


def failing_rows(df: DataFrame, failure: Column) -> DataFrame:
    """Rows for which the failure condition holds."""
    return df.filter(failure)


def future_rows(df: DataFrame, column: str, today: Column) -> DataFrame:
    """Rows dated after ``today``."""
    return failing_rows(df, F.col(column).cast("date") > today)


def negative_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose count or amount is below zero."""
    return failing_rows(df, F.col(column) < 0)


def _as_rows(counts: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One report row per check from one row of counts, columns _0, _1, ..."""
    rows = [
        f"named_struct('table_name', {sql_text(c.table)}, 'column_name', {sql_text(c.column)},"
        f" 'test_name', {sql_text(c.test)}, 'failures', _{i})"
        for i, c in enumerate(checks)
    ]
    return counts.selectExpr(f"inline(array({', '.join(rows)}))")


def _null_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """not_null checks of several columns in one aggregation."""
    counts = [
        F.count_if(F.col(c.column).isNull()).alias(f"_{i}") for i, c in enumerate(checks)
    ]
    return _as_rows(df.agg(*counts), checks)


def _value_counts(df: DataFrame, column: str, checks: Sequence[Check]) -> DataFrame:
    """unique and not_null checks of one column from its value counts. Counts are
    combined before the shuffle, NULLs included."""
    value = F.col(column)
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    failures = {
        UNIQUE: F.count_if(value.isNotNull() & (F.col("_n") > 1)),
        NOT_NULL: F.coalesce(F.sum(F.when(value.isNull(), F.col("_n"))), F.lit(0).cast("long")),
    }
    counts = [failures[c.test].alias(f"_{i}") for i, c in enumerate(checks)]
    return _as_rows(sizes.agg(*counts), checks)


def report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check: table_name, column_name, test_name, failures.

    A table is read once for all its not_null checks and once for each column
    that must be unique, whose NULLs are counted on the way.
    """
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        mine = [c for c in checks if c.table == name]
        for check in mine:
            if check.test not in (UNIQUE, NOT_NULL):
                raise ValueError(f"unknown test {check.test!r}")
        unique = dict.fromkeys(c.column for c in mine if c.test == UNIQUE)
        for column in unique:
            same = [c for c in mine if c.column == column]
            parts.append(_value_counts(tables[name], column, same))
        if nulls := [c for c in mine if c.column not in unique]:
            parts.append(_null_counts(tables[name], nulls))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def observed_nulls(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Observation | None]:
    """``df`` with the rows that its not_null checks count, counted while it is written."""
    nulls = [c for c in checks if c.test == NOT_NULL]
    if not nulls:
        return df, None
    seen = Observation()
    counts = [F.count_if(F.col(c.column).isNull()).alias(c.column) for c in nulls]
    return df.observe(seen, *counts), seen


def written_failures(
    checks: Sequence[Check], seen: Observation | None, stored: DataFrame
) -> dict[Check, int]:
    """Failures of a table that has been written: NULLs as observed, and each column that
    must be unique read from the files by itself."""
    nulls = [c for c in checks if c.test == NOT_NULL]
    found = {c: seen.get[c.column] for c in nulls} if seen else {}
    unique = [c for c in checks if c.test == UNIQUE]
    if unique:
        for r in report({c.table: stored for c in unique}, unique).collect():
            found[Check(r.table_name, r.column_name, UNIQUE)] = r.failures
    return found


def clean_report(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """The report of checks that found nothing."""
    rows = [(c.table, c.column, c.test, 0) for c in checks]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, test_name string, failures bigint"
    )


def require_none(failures: Mapping[Check, int]) -> None:
    bad = [f"{c.test}({c.table}.{c.column}): {n}" for c, n in failures.items() if n]
    if bad:
        raise QualityError("; ".join(bad))


def require_clean(result: DataFrame) -> None:
    """Raise if the report has failures. The report has one row per check."""
    bad = result.filter("failures > 0").collect()
    if bad:
        raise QualityError(
            "; ".join(f"{r.test_name}({r.table_name}.{r.column_name}): {r.failures}" for r in bad)
        )
