"""Keyed Parquet tables in folders, so that a merge rewrites only the folders it touches.

A row's folder is a hash of its key modulo the number of folders; the table is partitioned by
it. A merge reads and writes the folders of its increment. They are written as a new version
beside the former ones; nothing is overwritten, so readers in flight and failed writes find
what was there. Then the version is noted as a property of the table, which is the commit, and
the folders are pointed at it one by one. Whoever reads the table through ``layer_rows``, or
merges again, first finishes a commit that was cut off there: a half-pointed table would give
a watermark that hides the rows still missing.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratalake.operators.incremental import upsert
from stratalake.operators.quality import (
    Check,
    QualityError,
    observed_nulls,
    require_none,
    written_failures,
)
from stratalake.scratch import written

FOLDER = "_folder"
PENDING = "stratalake.pending"
LAYOUT = "stratalake.folders"
ADDED_AT_ONCE = 500


def folder_of(key: str, kind: T.DataType, folders: int) -> Column:
    """The hash by which Spark places rows in ``repartition(folders, key)``: a partition of
    that is a folder. The key is read as the table's type, as equal numbers of different
    types have different hashes."""
    return F.pmod(F.hash(F.col(key).cast(kind)), F.lit(folders)).alias(FOLDER)


def layout(spark: SparkSession, table: str) -> str | None:
    """``<folders>:<key>`` of a table in folders, else None."""
    return _properties(spark, table).get(LAYOUT)


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def write_all(df: DataFrame, key: str, folders: int, path: str, table: str) -> None:
    """``df`` as the new table ``table``, one file per folder."""
    kind = df.schema[key].dataType
    rows = df.repartition(folders, key).select("*", folder_of(key, kind, folders))
    rows.write.format("parquet").option("path", path).partitionBy(FOLDER).saveAsTable(table)
    df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{LAYOUT}' = '{folders}:{key}')")


def merge_folders(
    df: DataFrame, key: str, folders: int, path: str, table: str, checks: Sequence[Check] = ()
) -> None:
    """Merge ``df`` (unique on ``key``) into a table in folders; a version goes to ``path``
    and is checked before it is noted.

    Rows of the touched folders that stay are joined with the increment's keys where they
    are read; only the increment is shuffled, as long as its keys can be broadcast.
    """
    spark = df.sparkSession
    settle(spark, table)
    target = spark.table(table)
    rows = df.select("*", folder_of(key, target.schema[key].dataType, folders))
    # Read for its folders, its keys and its rows, so it is computed once.
    increment = written(rows, f"increment-{table}")
    touched = sorted(r[FOLDER] for r in increment.select(FOLDER).distinct().collect())
    if not touched:
        return
    merged = upsert(
        target.filter(F.col(FOLDER).isin(touched)), increment.repartition(folders, key), key
    )
    merged, seen = observed_nulls(merged, checks)
    merged.write.partitionBy(FOLDER).parquet(path)
    try:
        require_none(written_failures(checks, seen, spark.read.schema(merged.schema).parquet(path)))
    except QualityError:
        delete(spark, path)
        raise
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PENDING}' = '{path}')")
    settle(spark, table)


def settle(spark: SparkSession, table: str) -> None:
    """Point the folders of a noted version at it; nothing if none is noted."""
    path = _properties(spark, table).get(PENDING)
    if not path:
        return
    numbers = [int(name.partition("=")[2]) for name in _names(spark, path) if name.startswith(FOLDER)]
    known = {r.partition for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    fresh = [n for n in numbers if f"{FOLDER}={n}" not in known]
    for n in numbers:
        if f"{FOLDER}={n}" in known:
            spark.sql(f"ALTER TABLE {table} PARTITION ({FOLDER} = {n}) SET LOCATION '{path}/{FOLDER}={n}'")
    for i in range(0, len(fresh), ADDED_AT_ONCE):
        places = " ".join(
            f"PARTITION ({FOLDER} = {n}) LOCATION '{path}/{FOLDER}={n}'"
            for n in fresh[i : i + ADDED_AT_ONCE]
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {places}")
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{PENDING}')")
    spark.catalog.refreshTable(table)


def layer_rows(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a layer table, without the column that names the folder."""
    settle(spark, table)
    return spark.table(table).drop(FOLDER)


def vacuum(spark: SparkSession, table: str, root: str, keep_hours: float = 168) -> list[str]:
    """Delete folders of former versions below ``root``, the table's own folder, that the
    table does not point at and that are older than ``keep_hours``, which has to exceed the
    longest query and the longest merge. Returns what was deleted."""
    settle(spark, table)
    used = {_bare(f.rsplit("/", 1)[0]) for f in spark.table(table).inputFiles()}
    fs, folder = _file_system(spark, root)
    limit = (time.time() - keep_hours * 3600) * 1000
    gone = []
    for version in fs.listStatus(folder):
        for part in fs.listStatus(version.getPath()):
            place = part.getPath()
            if not place.getName().startswith(FOLDER) or part.getModificationTime() > limit:
                continue
            if _bare(place.toString()) not in used:
                fs.delete(place, True)
                gone.append(place.toString())
    return gone


def _bare(path: str) -> str:
    """A path without scheme: file:/a and file:///a are the same."""
    rest = path.partition(":")[2] if "://" in path or path.startswith("file:") else path
    return "/" + rest.lstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    fs, folder = _file_system(spark, path)
    fs.delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> Iterable[str]:
    fs, folder = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)]
