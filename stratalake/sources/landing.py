"""Scans of landed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Landed dataset. A declared schema saves the footer read that infers one and
    turns columns that the files lack into NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(body) of landed documents: one per file, or several ended by ``separator``."""
    if separator:
        return spark.read.option("lineSep", separator).text(path).toDF("body")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace("value", r"\n\z", "").alias("body")
    )
