"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

T = TypeVar("T")
_shipped: set[str] = set()
_kept: dict = {}


def kept(key: str, build: Callable[[], T]) -> T:
    """What ``build`` makes, kept by a worker between its tasks until another key is asked for:
    one operator's tables at a time, whatever ran in the worker before."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to Python workers, wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = f"{tempfile.mkdtemp(prefix='package-')}/{package.name}.zip"  # on the driver only
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shipped(query: Callable) -> Callable:
    """``query`` with the package's code shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return query(spark, *args)

    return run


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
    return name


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids get fold 0 and so never train."""
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % folds, F.lit(0))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per labelled id; contradicting rows go by majority, ties to 1."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias(label))
    )
