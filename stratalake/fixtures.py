"""Plants and licenses derived from the benchmark tables.

The modelled source tables are not shipped anywhere, so the registered queries
derive them from orders, customer and events. Row counts follow those tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratalake.contracts import (
    LANDING_LICENSES,
    LANDING_PLANTS,
    PLANT_META,
    PROVIDER_LABELS,
)
from stratalake.sources.landing import scan

AS_OF = dt.date(2019, 6, 30)
SPLIT = "2024-01-25 00:00:00"

ORDER_STATE = {"F": "closed", "O": "active", "P": "new"}
ORDER_PROVIDER = {
    "1-URGENT": "MODON",
    "2-HIGH": "RCJY",
    "3-MEDIUM": "ARAMCO",
    "4-NOT SPECIFIED": "OTHER",
}
EVENT_STATE = {
    "signup": "new",
    "view": "established",
    "click": "active",
    "purchase": "closed",
    "error": "canceled",
}


# Columns of the benchmark tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _shaped(df: DataFrame, ddl: str, columns: Mapping[str, str]) -> DataFrame:
    """Landing columns in declared order, from SQL expressions; others are NULL."""
    return df.selectExpr(
        *[
            f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in T.StructType.fromDDL(ddl).fields
        ]
    )


def _coded(column: str, codes: Mapping[str, str]) -> str:
    whens = " ".join(f"WHEN '{code}' THEN '{value}'" for code, value in codes.items())
    return f"CASE {column} {whens} END"


def _day(year: int, k: str, days: int, gap: int) -> str:
    """A date of its own range for each column, NULL for each ``gap``-th key."""
    return (
        f"CASE WHEN {k} % {gap} <> 0 THEN date_add(DATE '{year}-01-01', CAST({k} % {days} AS INT)) END"
    )


def _plant_rest(k: str) -> dict[str, str]:
    """Plant columns that no benchmark column stands for: values that differ from
    column to column, with some NULLs in each."""
    return {
        "address_id": f"CASE WHEN {k} % 6 <> 0 THEN {k} % 1000 + 1 END",
        "industrial_city_id": f"CASE WHEN {k} % 7 <> 0 THEN {k} % 37 + 1 END",
        "is_rent": f"CASE WHEN {k} % 11 <> 0 THEN {k} % 2 = 0 END",
        "has_approved_manpower": f"CASE WHEN {k} % 12 <> 0 THEN {k} % 3 = 0 END",
        "inside_industrial_city": f"CASE WHEN {k} % 13 <> 0 THEN {k} % 5 < 2 END",
        "closed_at": _day(2011, k, 1001, 4),
        "canceled_at": _day(2012, k, 1003, 5),
        "established_at": _day(2013, k, 1007, 6),
        "hs_12_confirmed_at": _day(2014, k, 1009, 7),
        "started_production_at": _day(2015, k, 1013, 8),
        "ndb_synched_at": _day(2016, k, 1019, 9),
        "ndb_last_ops_at": _day(2017, k, 1021, 10),
    }


def _plant_meta(k: str) -> str:
    """A meta document in which each field is missing for some keys."""
    fields = []
    for i, (name, kind) in enumerate(PLANT_META.items()):
        value = {
            "string": f"concat('{name.lower()} ', {k} % {90 + i})",
            "double": f"CAST({k} % {900 + i} AS DOUBLE) + 0.5D",
            "int": f"CAST({k} % {300 + i} AS INT)",
        }[kind]
        fields.append(f"'{name}', CASE WHEN {k} % {i + 5} <> 0 THEN {value} END")
    return f"to_json(named_struct({', '.join(fields)}))"


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plant per order."""
    return _shaped(
        table(spark, sf_dir, "orders"),
        LANDING_PLANTS,
        {
            "id": "o_orderkey",
            "license_id": """CASE WHEN o_orderkey % 13 = 0 THEN NULL
                WHEN o_orderkey % 17 = 0 THEN o_custkey + 1000000 ELSE o_custkey END""",
            "state": _coded("o_orderstatus", ORDER_STATE),
            "land_provider": _coded("o_orderpriority", ORDER_PROVIDER),
            "created_at": "o_orderdate",
            "updated_at": "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 30 + 1 AS INT))",
            "number": "o_orderkey + 7",
            "main_activity_code_l2": """CASE o_orderkey % 4 WHEN 1 THEN ''
                WHEN 2 THEN CAST(o_orderkey % 100 AS STRING) WHEN 3 THEN '  ' END""",
            "main_activity_code_l4": """CASE o_orderkey % 4 WHEN 2 THEN ''
                WHEN 3 THEN CAST(o_orderkey % 10000 AS STRING) WHEN 0 THEN '  ' END""",
            **_plant_rest("o_orderkey"),
        },
    )


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One license per customer."""

    def day(offset: str) -> str:
        return f"date_add(DATE '2015-01-01', CAST({offset} AS INT))"

    def flagged(divisor: int) -> str:
        return f"CASE WHEN c_custkey % {divisor} = 0 THEN DATE '2018-01-01' END"

    created = day("c_custkey % 1000")
    expiry = day("c_custkey % 1000 + 365 * (1 + c_custkey % 9)")
    return _shaped(
        table(spark, sf_dir, "customer"),
        LANDING_LICENSES,
        {
            "id": "c_custkey",
            "number": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END",
            "issue_date": f"CASE WHEN c_custkey % 19 <> 0 THEN {created} END",
            "expires_at": f"CASE WHEN c_custkey % 23 <> 0 THEN {expiry} END",
            "deleted_at": flagged(29),
            "canceled_at": flagged(31),
            "suspended_at": flagged(37),
            "created_at": created,
            "updated_at": day("c_custkey % 1000 + 3"),
            "renewed_at": _day(2016, "c_custkey", 997, 17),
            "cancelled_by": "CASE WHEN c_custkey % 31 = 0 THEN c_custkey % 40 + 7 END",
            "investment_size": """CASE c_custkey % 4 WHEN 1 THEN 'small' WHEN 2 THEN 'medium'
                WHEN 3 THEN 'large' END""",
            "investment_type": "CASE c_custkey % 3 WHEN 1 THEN 'local' WHEN 2 THEN 'foreign' END",
            "user_id": "c_custkey + 5000",
            "investor_id": "c_custkey % 50",
            "commercial_entity_id": "c_custkey % 70",
        },
    )


def plants_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plant version per event, many versions per user."""
    providers = ", ".join(f"'{code}'" for code in (*PROVIDER_LABELS, "ZZZ"))

    def text_number(value: str) -> str:
        return f"""CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN '  '
            WHEN 3 THEN CAST({value} AS STRING) END"""

    return _shaped(
        table(spark, sf_dir, "events"),
        LANDING_PLANTS,
        {
            "id": "user_id",
            "updated_at": "ts",
            "state": f"""CASE WHEN event_id % 11 = 0 THEN 'legacy'
                ELSE {_coded("event_type", EVENT_STATE)} END""",
            "land_provider": f"get(array({providers}), CAST(event_id % 15 AS INT))",
            "number": text_number("event_id"),
            "main_activity_code_l2": text_number("event_id % 100"),
            "main_activity_code_l4": text_number("event_id % 10000"),
            "license_id": "CASE WHEN user_id % 7 <> 0 THEN user_id % 40 END",
            "created_at": "date_add(DATE '2010-01-01', CAST(user_id % 5000 AS INT))",
            "meta": _plant_meta("event_id"),
            **_plant_rest("event_id"),
        },
    )


def before_split(column: str) -> Column:
    """Rows of the first load."""
    return F.col(column) <= F.lit(SPLIT).cast("timestamp_ntz")


def feed_until_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plants_feed(spark, sf_dir).filter(before_split("updated_at"))
