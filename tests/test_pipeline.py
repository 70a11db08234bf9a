"""Layer tables, the layered build and the streaming load."""

from __future__ import annotations

import dataclasses
import datetime as dt

import pytest
from test_models import DAY, P, T0, increments, keys, licenses, plants

from stratalake import contracts
from stratalake.operators.incremental import upsert
from stratalake.operators.quality import QualityError
from stratalake.plans import bronze, pipeline
from stratalake.scratch import written
from stratalake.sinks.tables import Lake, merge_table, replace_table
from stratalake.streaming.bronze import follow_landing


@pytest.fixture
def lake(spark, tmp_path):
    yield Lake(str(tmp_path / "lake"))
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"DROP DATABASE IF EXISTS {layer} CASCADE")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "id bigint, v string")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_keeps_running_readers_on_their_version(spark, lake):
    replace_table(frame(spark, (1, "a")), lake, "bronze.t")
    reader = spark.table("bronze.t")
    replace_table(frame(spark, (2, "b")), lake, "bronze.t")
    assert content(reader) == [(1, "a")]
    assert content(spark.table("bronze.t")) == [(2, "b")]


def test_replace_by_a_query_on_the_same_table(spark, lake):
    replace_table(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t")
    replace_table(spark.table("bronze.t").filter("id = 2"), lake, "bronze.t")
    assert content(spark.table("bronze.t")) == [(2, "b")]


def test_replace_with_other_columns(spark, lake):
    replace_table(frame(spark, (1, "a")), lake, "bronze.t")
    replace_table(spark.range(3), lake, "bronze.t")
    assert spark.table("bronze.t").columns == ["id"]
    assert spark.table("bronze.t").count() == 3


def test_merge_creates_then_updates(spark, lake):
    merge_table(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t", "id")
    merge_table(frame(spark, (2, "B"), (3, "c")), lake, "bronze.t", "id")
    assert content(spark.table("bronze.t")) == [(1, "a"), (2, "B"), (3, "c")]


def data_files(spark, table):
    return [f.rsplit("/", 1)[1] for f in spark.table(table).inputFiles()]


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_bucketed_merge_moves_only_the_increment(spark, lake, limit):
    lake = dataclasses.replace(lake, buckets=4)
    ids = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id", f"'{v}' as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        merge_table(ids(0, 1000, "a"), lake, "bronze.t", "id")
        assert len(data_files(spark, "bronze.t")) == 4
        for step in range(3):
            merge_table(ids(900 + step, 1100 + step, f"b{step}"), lake, "bronze.t", "id")
        table = spark.table("bronze.t")
        counts = {r.v: r["count"] for r in table.groupBy("v").count().collect()}
        assert counts == {"a": 900, "b0": 1, "b1": 1, "b2": 200}
        # Files do not pile up: each bucket is rewritten by its merge.
        assert len(data_files(spark, "bronze.t")) <= 8
        keys_ = written(ids(950, 1000, "c"), "test").repartition(4, "id")
        merged = upsert(table, keys_, "id", co_located=True)
        text = merged._jdf.queryExecution().executedPlan().toString()
        kept = text[text.index("ShuffledHashJoin") :]
        target_side = kept[: kept.index("FileScan parquet spark_catalog.bronze.t")]
        assert "Exchange" not in target_side and "Bucketed: true" in kept
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketing_an_existing_table(spark, lake):
    merge_table(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t", "id")
    bucketed = dataclasses.replace(lake, buckets=2)
    merge_table(frame(spark, (2, "B"), (3, "c")), bucketed, "bronze.t", "id")
    merge_table(frame(spark, (3, "C"), (4, "d")), bucketed, "bronze.t", "id")
    assert content(spark.table("bronze.t")) == [(1, "a"), (2, "B"), (3, "C"), (4, "d")]
    assert [t.name for t in spark.catalog.listTables("bronze")] == ["t"]


def test_a_failed_write_leaves_the_table(spark, lake):
    replace_table(frame(spark, (1, "a")), lake, "bronze.t")
    broken = spark.createDataFrame([("x",)], "s string").selectExpr(
        "cast(s as bigint) as id", "s as v"
    )
    with pytest.raises(Exception):
        replace_table(broken, lake, "bronze.t")
    assert content(spark.table("bronze.t")) == [(1, "a")]


def test_selection():
    assert pipeline.selected(layers=["bronze"]) == ["stg_plants", "stg_licenses"]
    assert pipeline.selected(domains=["shared"]) == ["dw_dim_date"]
    assert pipeline.selected(layers=["silver"], domains=["plants"]) == ["dw_dim_plant_profile"]
    assert pipeline.selected() == list(pipeline.MODELS)


def landing(spark, plant_rows):
    return {
        "plants": plant_rows,
        "licenses": licenses(
            spark,
            {"id": 1, "updated_at": T0, "expires_at": T0 + 365 * DAY},
            {"id": 2, "updated_at": T0},
        ),
    }


@pytest.mark.parametrize("buckets", [None, 3])
def test_build_increment_and_refresh(spark, lake, buckets):
    lake = dataclasses.replace(lake, buckets=buckets)
    first, feed = increments(spark)
    report = pipeline.run(spark, landing(spark, first), lake, P)
    assert report.count() == len(pipeline.CHECKS) == 15
    assert spark.table("silver.dw_dim_date").count() == 7670
    assert spark.table("gold.dm_plant").agg({"total_plant": "sum"}).first()[0] == 3

    pipeline.run(spark, landing(spark, feed), lake, P)
    stage = spark.table("bronze.stg_plants")
    assert keys(stage, "PLANT_KEY", "PLANT_ID") == {10: 1, 20: 2, 40: 3, 5: 4, 15: 5}
    assert spark.table("gold.dm_plant").agg({"total_plant": "sum"}).first()[0] == 5

    pipeline.run(spark, landing(spark, feed), lake, P, full_refresh=True)
    stage = spark.table("bronze.stg_plants")
    assert keys(stage, "PLANT_KEY", "PLANT_ID") == {5: 1, 10: 2, 15: 3, 20: 4, 40: 5}


def test_subset_uses_stored_tables(spark, lake):
    first, _ = increments(spark)
    pipeline.build(spark, landing(spark, first), lake, P)
    report = pipeline.run(spark, landing(spark, first), lake, P, layers=["gold"])
    tables = {r.table_name for r in report.collect()}
    assert tables == {"plants", "licenses", "dm_plant"}


def test_calendar_parameters(spark, lake):
    params = dataclasses.replace(P, dim_date_start="2024-01-01", dim_date_end="2024-01-31")
    pipeline.build(spark, {}, lake, params, domains=["shared"])
    assert spark.table("silver.dw_dim_date").count() == 31


def test_bad_landing_fails_the_run(spark, lake):
    rows = plants(spark, {"id": 1, "updated_at": T0}, {"id": 2})
    with pytest.raises(QualityError, match=r"not_null\(plants.updated_at\): 1"):
        pipeline.run(spark, landing(spark, rows), lake, P)


def test_repeated_license_stops_before_the_join(spark, lake):
    stage = bronze.stg_licenses(landing(spark, plants(spark))["licenses"], P)
    replace_table(stage.unionByName(stage), lake, "bronze.stg_licenses")
    with pytest.raises(QualityError, match="unique"):
        pipeline.build(spark, {}, lake, P, layers=["silver"], domains=["plants"])


def test_streaming_load_equals_the_batch_load(spark, lake, tmp_path):
    first, feed = increments(spark)
    path, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    follow = lambda: follow_landing(
        spark, path, contracts.LANDING_PLANTS, bronze.stg_plants, lake,
        "bronze.stg_plants", "PLANT_ID", checkpoint, P,
    ).awaitTermination()
    first.write.parquet(path)
    follow()
    feed.write.mode("append").parquet(path)
    follow()
    follow()  # nothing new
    stage = spark.table("bronze.stg_plants")
    assert keys(stage, "PLANT_KEY", "PLANT_ID") == {10: 1, 20: 2, 40: 3, 5: 4, 15: 5}
    assert {r.PLANT_ID for r in stage.collect() if r.UPDATED_AT > T0} == {40, 15, 5}
    assert stage.first().LOAD_DATE == dt.date(2024, 6, 30)


def versions(spark):
    """Plants in versions of which some come late, twice or at the same time."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    return [
        plants(
            spark,
            {"id": 1, "updated_at": at(5), "state": "active"},
            {"id": 2, "updated_at": at(1), "state": "new"},
            {"id": 3, "updated_at": at(2), "state": "new"},
        ),
        plants(  # older than the table's highest time
            spark,
            {"id": 1, "updated_at": at(3), "state": "closed"},
            {"id": 4, "updated_at": at(1), "state": "established"},
            {"id": 2, "updated_at": at(4), "state": "closed"},
        ),
        plants(  # the same version with another content, and a repeated row
            spark,
            {"id": 3, "updated_at": at(2), "state": "canceled"},
            {"id": 2, "updated_at": at(4), "state": "closed"},
            {"id": 5, "updated_at": None, "state": "new"},
        ),
        plants(spark, {"id": 5, "updated_at": at(0), "state": "closed"}),
    ]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 1, 0, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_streaming_in_any_order_equals_one_batch(spark, lake, tmp_path, order):
    files = versions(spark)
    path, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")

    def follow(checkpoint=checkpoint):
        follow_landing(
            spark, path, contracts.LANDING_PLANTS, bronze.stg_plants, lake,
            "bronze.stg_plants", "PLANT_ID", checkpoint, P,
        ).awaitTermination()

    for i in order:
        files[i].coalesce(1).write.mode("append").parquet(path)
        follow()
    whole = bronze.stg_plants(spark.read.schema(contracts.LANDING_PLANTS).parquet(path), P)
    rows = lambda df: sorted(map(str, df.drop("PLANT_KEY").collect()))
    assert rows(spark.table("bronze.stg_plants")) == rows(whole)
    numbered = spark.table("bronze.stg_plants").select("PLANT_KEY", "PLANT_ID").collect()
    assert sorted(r.PLANT_KEY for r in numbered) == [1, 2, 3, 4, 5]
    follow(str(tmp_path / "again"))  # all files a second time, as one batch
    assert rows(spark.table("bronze.stg_plants")) == rows(whole)
    again = spark.table("bronze.stg_plants").select("PLANT_KEY", "PLANT_ID").collect()
    assert sorted(again) == sorted(numbered)


def test_an_increment_reads_the_target_three_times_at_most(spark, lake):
    """Watermark and highest key, known keys, merge."""
    first, feed = increments(spark)
    replace_table(bronze.stg_plants(first, P), lake, "bronze.t", "PLANT_ID")
    target = spark.table("bronze.t")
    reads = []
    tracked = target.filter("true")
    original = tracked.agg
    tracked.agg = lambda *a: reads.append("agg") or original(*a)
    bronze.stg_plants(feed, P, target=tracked).count()
    assert reads == ["agg"]


def test_a_failed_rename_restores_the_table(spark, lake, monkeypatch):
    replace_table(frame(spark, (1, "a")), lake, "bronze.t")
    sql = type(spark).sql

    def failing(self, text, *a, **k):
        if text.startswith("ALTER TABLE bronze.t_") and text.endswith("RENAME TO bronze.t") and "former" not in text:
            raise RuntimeError("lost")
        return sql(self, text, *a, **k)

    monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises(RuntimeError):
        replace_table(spark.range(3), lake, "bronze.t")
    monkeypatch.undo()
    assert content(spark.table("bronze.t")) == [(1, "a")]


def test_promotion_to_a_table(spark, lake):
    pipeline.promote(frame(spark, (1, "a"), (2, "b")), lake, "bronze.t")
    pipeline.promote(frame(spark, (3, "c")), lake, "bronze.t")
    assert content(spark.table("bronze.t")) == [(3, "c")]
