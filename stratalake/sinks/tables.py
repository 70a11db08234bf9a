"""Layer tables: full replacement and keyed merge.

A table format with row-level operations (Iceberg, Delta) is used through its
own commits; a merge there rewrites the files it touches, so it is the form for tables
whose increments are small beside them. Plain Parquet has no commits, so each version
is written to a new folder and the table is then pointed at it: readers see the old or
the new version, never a mixture, and a failed write leaves the table as it was. A merge into
a table in folders is seen folder by folder (``sinks/folders.py``). Only if the columns change,
or a table in folders is replaced, is there a moment without the table, between two renames; a crash
there leaves the former version under ``<table>_former_<version>``. Old folders stay until
the storage's own retention removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.operators.incremental import upsert
from stratalake.operators.quality import (
    Check,
    QualityError,
    observed_nulls,
    require_none,
    written_failures,
)
from stratalake.scratch import written
from stratalake.sinks.folders import delete, layer_rows, layout, merge_folders, write_all


@dataclass(frozen=True)
class Lake:
    """Where layer tables live and how they are stored.

    ``buckets`` stores keyed Parquet tables in that many buckets of the key: a
    merge then moves only the increment, whatever its size, and never shuffles
    the table, but rewrites all of it. ``folders`` stores them in that many folders by
    a hash of the key: a merge then reads and writes only the folders of its increment.
    """

    root: str
    table_format: str = "parquet"
    buckets: int | None = None
    folders: int | None = None

    def __post_init__(self) -> None:
        if self.buckets and self.folders:
            raise ValueError("a table is stored in buckets or in folders")

    def buckets_for(self, key: str | None) -> int | None:
        return self.buckets if key and self.table_format == "parquet" else None

    def folders_for(self, key: str | None) -> int | None:
        return self.folders if key and self.table_format == "parquet" else None

    def folder(self, table: str) -> str:
        """Where the versions of a Parquet table are."""
        return f"{self.root.rstrip('/')}/{table.replace('.', '/')}"


def replace_table(
    df: DataFrame, lake: Lake, table: str, key: str | None = None, checks: Sequence[Check] = ()
) -> DataFrame:
    """Make ``table`` (layer.name) hold exactly ``df``.

    ``checks`` are made on the Parquet files before they become the table: if one fails, the
    table stays as it was, and ``QualityError`` is raised. NULLs are counted by the write itself.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{table.split('.')[0]}`")
    if lake.table_format != "parquet":
        df.writeTo(table).using(lake.table_format).createOrReplace()
        return spark.table(table)
    buckets = lake.buckets_for(key)
    return _publish(df.repartition(buckets, key) if buckets else df, lake, table, key, checks)


def merge_table(
    df: DataFrame, lake: Lake, table: str, key: str, checks: Sequence[Check] = ()
) -> DataFrame:
    """Merge ``df`` (unique on ``key``) into ``table``: matched rows are replaced,
    new rows added, all others kept. Creates the table on the first run. ``checks`` as in
    ``replace_table``; of a table in folders they see the rewritten folders."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        return replace_table(df, lake, table, key, checks)
    if lake.table_format != "parquet":
        (
            df.alias("s")
            .mergeInto(table, F.expr(f"{table}.`{key}` = s.`{key}`"))
            .whenMatched()
            .updateAll()
            .whenNotMatched()
            .insertAll()
            .merge()
        )
        return spark.table(table)
    if folders := lake.folders_for(key):
        if layout(spark, table) == f"{folders}:{key}":
            version = f"{lake.folder(table)}/version={uuid.uuid4().hex}"
            merge_folders(df, key, folders, version, table, checks)
            return layer_rows(spark, table)
        increment = written(df, f"increment-{table}")
        merged = upsert(layer_rows(spark, table), increment, key)
        return _publish(merged, lake, table, key, checks)
    # The increment is read twice (keys, then rows), so it is computed once.
    increment = written(df, f"increment-{table}")
    target = layer_rows(spark, table)
    buckets = lake.buckets_for(key)
    if not buckets:
        merged = upsert(target, increment, key)
    elif _storage(spark, table) == (_columns(df), str(buckets), f"[`{key}`]"):
        merged = upsert(target, increment.repartition(buckets, key), key, co_located=True)
    else:
        merged = upsert(target, increment, key).repartition(buckets, key)
    return _publish(merged, lake, table, key, checks)


def _publish(
    df: DataFrame, lake: Lake, table: str, key: str | None, checks: Sequence[Check]
) -> DataFrame:
    """Write a new version, check it and point the table at it."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    path = f"{lake.folder(table)}/version={version}"
    staged = f"{table}_{version}"
    df, seen = observed_nulls(df, checks)
    if folders := lake.folders_for(key):
        write_all(df, key, folders, path, staged)
    else:
        writer = df.write.format("parquet").option("path", path)
        if buckets := lake.buckets_for(key):
            writer = writer.bucketBy(buckets, key)
        writer.saveAsTable(staged)
    try:
        require_none(written_failures(checks, seen, spark.table(staged)))
    except QualityError:
        spark.sql(f"DROP TABLE {staged}")
        delete(spark, path)
        raise
    if not spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    elif not folders and _storage(spark, staged) == _storage(spark, table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.sql(f"DROP TABLE {staged}")  # the entry only; the files have a given path
    else:
        # Other columns, or folders, which have places of their own: the former entry
        # steps aside and is dropped last.
        former = f"{table}_former_{version}"
        spark.sql(f"ALTER TABLE {table} RENAME TO {former}")
        try:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
        except Exception:
            spark.sql(f"ALTER TABLE {former} RENAME TO {table}")
            raise
        spark.sql(f"DROP TABLE {former}")
    return layer_rows(spark, table)


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def _storage(
    spark: SparkSession, table: str
) -> tuple[list[tuple[str, str]], str | None, str | None]:
    """Columns, bucket count and bucket columns of a table."""
    described = spark.sql(f"DESCRIBE EXTENDED {table}")
    wanted = described.filter(F.col("col_name").isin("Num Buckets", "Bucket Columns"))
    facts = {r.col_name: r.data_type for r in wanted.collect()}
    return _columns(spark.table(table)), facts.get("Num Buckets"), facts.get("Bucket Columns")
