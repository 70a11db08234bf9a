"""Raw documents to encoded training data in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's documents. All but
the last return the columns of documents; the last adds the piece ids and whether they
decode to the text.

* toxicity: documents predicted toxic go; the models learn from the labels in ``sf_dir``.
* line_dedup: blocks of lines that an earlier document has are cut from later ones; a document
  that keeps less than ``LEAST_LEFT`` of its characters goes with them.
* near_duplicates: of each group of texts linked by SimHash fingerprints that differ in few bits
  the first document stays.
* decontamination: documents with a window of a benchmark item go.
* encoding: the texts as SentencePiece ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.fixtures import table
from stratalake.llm import decontaminate, linededup, pieces, simhash, toxicity
from stratalake.llm.common import ship_package
from stratalake.scratch import written

LEAST_LEFT = 0.2
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.clean_documents(docs, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return linededup.dedup_lines(docs, least_left=LEAST_LEFT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Trained models, alignment and similarity search are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
