"""Landing datasets: full snapshots as Parquet, JSON records or raw documents.

A dataset is written to a hidden folder beside its own, which takes the place of the former
one when it is complete: a load that fails leaves the former snapshot as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from stratalake.contracts import IDENTIFIER
from stratalake.functions.casts import promote_integers

ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS"
T = TypeVar("T")


def check_identifier(name: str, kind: str) -> str:
    """Names become paths and quoted SQL, so only a safe alphabet is accepted, and no
    name that stands for this or the upper folder."""
    if not re.fullmatch(IDENTIFIER, name or "") or name in (".", ".."):
        raise ValueError(f"{kind} may hold letters, digits, '_', '.' and '-' only: {name!r}")
    return name


def check_key(key: str, kind: str) -> str:
    """A key of names separated by "/", without slashes around it; "" has no name."""
    names = (key or "").strip("/")
    return "/".join(check_identifier(name, kind) for name in names.split("/")) if names else ""


def table_path(root: str, schema: str, table: str, prefix: str | None = None) -> str:
    """Directory of a landed table: <root>/<prefix or schema>/<table>/data.parquet."""
    check_identifier(schema, "schema")
    check_identifier(table, "table")
    folder = check_key(prefix, "prefix") if prefix else schema
    return f"{root.rstrip('/')}/{folder}/{table}/data.parquet"


def parquet_key(key: str) -> str:
    """Key of a tabular API dataset; it always ends in .parquet."""
    name = check_key(key, "key")
    return name if name.endswith(".parquet") else f"{name.removesuffix('.json') or 'data'}.parquet"


def document_key(key: str) -> str:
    """Key of a raw document: a folder of its own below the key, so that a document
    never shares a folder with the datasets of longer keys."""
    return f"{check_key(key, 'key')}/data.json".lstrip("/")


def check_apart(paths: Sequence[str]) -> None:
    """Refuse datasets of which one would replace another or hold it."""
    for i, one in enumerate(paths):
        for other in paths[i + 1 :]:
            short, long = sorted((one.rstrip("/") + "/", other.rstrip("/") + "/"), key=len)
            if long.startswith(short):
                raise ValueError(f"datasets overlap: {one} and {other}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], T]) -> T:
    """Call ``write`` with a folder beside ``path``, then put that folder in its place.

    The former folder is renamed first and deleted last. If the job dies between the two
    renames, the next load finds it and puts it back before it begins.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    run = uuid.uuid4().hex
    fresh, former = (
        hadoop.Path(target.getParent(), f".{target.getName()}.{kind}-{run}")
        for kind in ("new", "old")
    )

    def move(source, to) -> None:
        if not fs.rename(source, to):
            raise OSError(f"cannot rename {source} to {to}")

    if not fs.exists(target):
        left = fs.globStatus(hadoop.Path(target.getParent(), f".{target.getName()}.old-*"))
        if left:
            move(left[0].getPath(), target)
    try:
        result = write(fresh.toString())
        if fs.exists(target):
            move(target, former)
        try:
            move(fresh, target)
        except Exception:
            if fs.exists(former):
                move(former, target)
            raise
    except Exception:
        fs.delete(fresh, True)
        raise
    fs.delete(former, True)
    return result


def with_count(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame with its row count observed while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_snapshot(df: DataFrame, path: str, promote: bool = False) -> int:
    """Replace the dataset at ``path`` by ``df`` and return the row count, which is
    taken in the same pass. An empty frame still leaves a file with the schema."""

    def write(folder: str) -> int:
        counted, seen = with_count(promote_integers(df) if promote else df)
        counted.write.parquet(folder)
        return seen.get["rows"]

    return replace_folder(df.sparkSession, path, write)


def in_key_order(df: DataFrame, key: str) -> DataFrame:
    """Rows laid out by key: ranges over files, sorted inside each. The order is
    that of a sorted export; no global sort in one task. The row position is a
    second range key, so that a hot key runs over several files instead of one."""
    placed = df.withColumn("_position", F.monotonically_increasing_id())
    return placed.repartitionByRange(key, "_position").drop("_position").sortWithinPartitions(key)


def write_records(df: DataFrame, path: str) -> int:
    """Replace the dataset at ``path`` by JSON records, one per line, ISO dates.
    NULL fields are kept."""

    def write(folder: str) -> int:
        counted, seen = with_count(df)
        (
            counted.write.option("timestampFormat", ISO_TIMESTAMP + "XXX")
            .option("timestampNTZFormat", ISO_TIMESTAMP)
            .option("ignoreNullFields", False)
            .json(folder)
        )
        return seen.get["rows"]

    return replace_folder(df.sparkSession, path, write)


def write_documents(bodies: DataFrame, column: str, path: str, separator: str = "\n") -> int:
    """Replace the dataset at ``path`` by raw documents, as they came, and return how
    many there are. Several documents with line breaks in them need a separator that
    none of them holds; a single document does not."""

    def write(folder: str) -> int:
        counted, seen = with_count(bodies.select(F.col(column).cast("string")))
        counted.write.option("lineSep", separator).text(folder)
        return seen.get["rows"]

    return replace_folder(bodies.sparkSession, path, write)


def counts_of(rows: Mapping[str, int], spark: SparkSession) -> DataFrame:
    """One row per written dataset: dataset, total_rows."""
    return spark.createDataFrame(list(rows.items()), "dataset string, total_rows bigint")


def load_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: dataset, total_rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("total_rows")).select(
            F.lit(name).alias("dataset"), "total_rows"
        )
        for name, df in datasets.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
