"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.fixtures import table
from stratalake.llm import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    html_tree,
    linededup,
    pieces,
    quality_rules,
    rule_ensemble,
    secrets,
    simhash,
    spelling,
    toxicity,
    warc,
)
from stratalake.llm.common import shipped


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, deleted="deleted_lines")


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(table(spark, d, "documents"))


def op4_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.report(table(spark, d, "documents"))


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_tree.report(table(spark, d, "pages"))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.components(table(spark, d, "documents"))


def op9_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents").select("doc_id", "text")).drop("text")


def op10_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return rule_ensemble.report(table(spark, d, "documents"), table(spark, d, "labels"))


def op11_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.report(table(spark, d, "documents"))


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return hard_negatives.report(table(spark, d, "embeddings"))


def op13_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.report(table(spark, d, "documents"))


QUERIES = {
    query.__name__: shipped(query)
    for query in (
        op1_line_dedup,
        op2_toxicity,
        op3_quality_rules,
        op4_secret_scan,
        op5_warc,
        op6_decontamination,
        op7_html_extraction,
        op8_simhash,
        op9_sentencepiece,
        op10_quality_classifier,
        op11_spelling,
        op12_hard_negatives,
        op13_byte_bpe,
    )
}
