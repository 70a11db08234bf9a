"""Every registered query against DuckDB on whole tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as driver
from stratalake import contracts
from stratalake.checks import oracles, queries as checks

QUERIES = checks.QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).columns[-1] == "total_plant"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    result = QUERIES[name](spark, sf_dir)
    with compare.duck(sf_dir) as con:
        assert compare.difference(result, con, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["stg_plants", "stg_plants_meta", "stg_licenses", "dim_plant_profile"])
def test_every_column_can_show_a_fault(name):
    """No column is NULL in all rows or equal to another of its type, so feeding one from
    the wrong source, or swapping two, changes the result."""
    with compare.duck("/root/testdata/sf0.01") as con:
        rows = con.sql(driver.oracle_sql()[name])
        types, columns = list(map(str, rows.types)), rows.columns
        values = dict(zip(columns, zip(*rows.fetchall())))
    without = set() if name == "stg_plants_meta" else {*contracts.PLANT_META, *contracts.LICENSE_META}
    without |= {"LICENSE_AREA", "LICENSE_CITY"}
    seen = [c for c in columns if c not in without]
    assert [c for c in seen if set(values[c]) == {None}] == []
    for i, a in enumerate(seen):
        for b in seen[i + 1 :]:
            if types[columns.index(a)] == types[columns.index(b)]:
                assert values[a] != values[b], (a, b)


def test_labels_of_the_sql_are_those_of_the_code():
    assert oracles.STATE_LABELS == contracts.STATE_LABELS
    assert oracles.PROVIDER_LABELS == contracts.PROVIDER_LABELS
    assert (oracles.PLANT_META, oracles.LICENSE_META) == (contracts.PLANT_META, contracts.LICENSE_META)
