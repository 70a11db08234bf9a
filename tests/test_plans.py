"""Physical plans of the registered queries."""

from __future__ import annotations

import re

import pytest

from stratalake.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, SF_DIR)) for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(plans, name):
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plans[name], operator


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_task_stages_get_aggregates_only(plans, name):
    """What enters a single partition has been aggregated before."""
    lines = plans[name].splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1], line


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("dm_plant", "customer", {"c_custkey"}),
        ("license_status", "customer", {"c_custkey"}),
        ("fact_by_calendar", "lineitem", {"l_shipdate"}),
        ("dq_unique", "lineitem", {"l_orderkey", "l_linenumber"}),
        ("date_parts_on_orders", "orders", {"o_orderkey", "o_orderdate"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, table, columns):
    df = QUERIES[name](spark, SF_DIR)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    found = [
        set(re.findall(r"(\w+):", schema))
        for schema in re.findall(
            rf"Location: InMemoryFileIndex \[[^\]]*{table}\.parquet\](?:.|\n)*?ReadSchema: struct<(.*)>",
            text,
        )
    ]
    assert found and all(f == columns for f in found)


def test_negative_amounts_are_filtered_in_the_scan(plans):
    assert "LessThan(c_acctbal,0.0)" in plans["dq_no_negative_counts"]
