"""Checks as part of a table's write."""

from __future__ import annotations

import dataclasses

import pytest
from test_models import P, T0, increments, keys, plants
from test_pipeline import content, frame, lake, landing  # noqa: F401

from stratalake.operators.quality import NOT_NULL, UNIQUE, Check, QualityError
from stratalake.plans import pipeline
from stratalake.sinks.folders import layer_rows
from stratalake.sinks.tables import merge_table, replace_table

CHECKS = [Check("t", "id", NOT_NULL), Check("t", "v", NOT_NULL), Check("t", "id", UNIQUE)]
LAYOUTS = [{}, {"buckets": 2}, {"folders": 3}]


@pytest.fixture(params=LAYOUTS, ids=["plain", "buckets", "folders"])
def layout(request, lake):  # noqa: F811
    return dataclasses.replace(lake, **request.param)


def files(lake, table="bronze.t"):  # noqa: F811
    from pathlib import Path

    return sorted(str(p) for p in Path(lake.folder(table)).rglob("*.parquet"))


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        (((1, "a"), (None, "b")), r"not_null\(t.id\): 1$"),
        (((1, None), (2, None)), r"not_null\(t.v\): 2$"),
        (((1, "a"), (1, "b"), (2, "c")), r"unique\(t.id\): 1$"),
        (((1, "a"), (1, None), (None, "c")), r"not_null\(t.id\): 1; not_null\(t.v\): 1; unique\(t.id\): 1"),
    ],
)
def test_a_failing_check_leaves_the_table(spark, layout, bad, message):
    replace_table(frame(spark, (7, "x")), layout, "bronze.t", "id", CHECKS)
    before = files(layout)
    with pytest.raises(QualityError, match=message):
        replace_table(frame(spark, *bad), layout, "bronze.t", "id", CHECKS)
    assert content(layer_rows(spark, "bronze.t")) == [(7, "x")]
    assert files(layout) == before  # the refused files are gone
    assert [t.name for t in spark.catalog.listTables("bronze")] == ["t"]


def test_a_failing_merge_leaves_the_table(spark, layout):
    replace_table(frame(spark, (1, "a"), (2, "b")), layout, "bronze.t", "id", CHECKS)
    before = files(layout)
    with pytest.raises(QualityError, match="not_null"):
        merge_table(frame(spark, (2, None), (3, "c")), layout, "bronze.t", "id", CHECKS)
    assert content(layer_rows(spark, "bronze.t")) == [(1, "a"), (2, "b")]
    assert files(layout) == before
    merge_table(frame(spark, (2, "B"), (3, "c")), layout, "bronze.t", "id", CHECKS)
    assert content(layer_rows(spark, "bronze.t")) == [(1, "a"), (2, "B"), (3, "c")]


def test_a_first_write_that_fails_makes_no_table(spark, layout):
    with pytest.raises(QualityError):
        merge_table(frame(spark, (None, "a")), layout, "bronze.t", "id", CHECKS)
    assert not spark.catalog.tableExists("bronze.t")


@pytest.mark.parametrize("folders", [None, 4])
def test_build_with_checks_first(spark, lake, folders):  # noqa: F811
    lake = dataclasses.replace(lake, folders=folders)  # noqa: F811
    first, feed = increments(spark)
    plain = pipeline.run(spark, landing(spark, first), lake, P)
    again = pipeline.run(spark, landing(spark, feed), lake, P, check_first=True)
    assert again.schema == plain.schema and sorted(again.collect()) == sorted(plain.collect())
    stage = layer_rows(spark, "bronze.stg_plants")
    assert keys(stage, "PLANT_KEY", "PLANT_ID") == {10: 1, 20: 2, 40: 3, 5: 4, 15: 5}
    assert spark.table("gold.dm_plant").agg({"total_plant": "sum"}).first()[0] == 5


def test_only_columns_that_must_be_unique_are_read_again(spark, lake, monkeypatch):  # noqa: F811
    """The NULL checks come with the write; of the files one column is read."""
    from stratalake.operators import quality

    scans = []
    report = quality.report

    def noted(tables, checks):
        result = report(tables, checks)
        scans.append(result._jdf.queryExecution().executedPlan().toString())
        return result

    monkeypatch.setattr(quality, "report", noted)
    replace_table(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t", "id", CHECKS)
    (plan,) = scans
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<id:bigint>" in plan
    replace_table(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t", "id", CHECKS[:2])
    assert len(scans) == 1


def test_bad_landing_publishes_nothing(spark, lake):  # noqa: F811
    rows = plants(spark, {"id": 1, "updated_at": T0}, {"id": 2})
    with pytest.raises(QualityError, match=r"not_null\(plants.updated_at\): 1"):
        pipeline.run(spark, landing(spark, rows), lake, P, check_first=True)
    assert not spark.catalog.tableExists("bronze.stg_plants")


def test_a_faulty_model_is_not_published(spark, lake, monkeypatch):  # noqa: F811
    from stratalake.plans import silver

    first, _ = increments(spark)
    pipeline.run(spark, landing(spark, first), lake, P, check_first=True)
    profile = silver.dim_plant_profile
    monkeypatch.setattr(silver, "dim_plant_profile", lambda *a: profile(*a).unionByName(profile(*a)))
    with pytest.raises(QualityError, match=r"unique\(dw_dim_plant_profile.PLANT_ID\): 3"):
        pipeline.run(spark, landing(spark, first), lake, P, check_first=True)
    assert spark.table("silver.dw_dim_plant_profile").count() == 3
    assert spark.table("gold.dm_plant").agg({"total_plant": "sum"}).first()[0] == 3
