"""Dedup, numbering, incremental reads, merge, joins, spines and checks."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from stratalake.operators import quality
from stratalake.operators.dedup import latest_per_key
from stratalake.operators.incremental import newer_than, upsert, watermark
from stratalake.operators.joins import left_join_spread
from stratalake.operators.numbering import add_surrogate_key, attach_keys, rank_ids
from stratalake.operators.spine import date_bounds, date_spine

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)

VERSIONS = "id bigint, updated_at timestamp_ntz, payload string"


def versions(spark, rows):
    return spark.createDataFrame(rows, VERSIONS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# dedup


def test_latest_wins_and_null_version_is_last(spark):
    df = versions(spark, [(1, T0, "a"), (1, T0 + HOUR, "b"), (1, None, "c"), (2, None, "d")])
    assert rows(latest_per_key(df, "id", "updated_at")) == [(1, T0 + HOUR, "b"), (2, None, "d")]


def test_ties_do_not_depend_on_layout(spark):
    data = [(1, T0, f"p{i}") for i in range(50)]
    once = rows(latest_per_key(versions(spark, data).repartition(1), "id", "updated_at"))
    again = rows(latest_per_key(versions(spark, data[::-1]).repartition(7), "id", "updated_at"))
    assert len(once) == 1 and once == again


def test_named_tie_breaker(spark):
    df = versions(spark, [(1, T0, "a"), (1, T0, "z"), (1, T0, None)])
    assert rows(latest_per_key(df, "id", "updated_at", ["payload"])) == [(1, T0, "z")]


def test_map_columns_are_allowed(spark):
    df = versions(spark, [(1, T0, "a"), (1, T0 + HOUR, "b")])
    df = df.withColumn("m", F.create_map(F.lit("k"), "payload"))
    assert latest_per_key(df, "id", "updated_at").first().payload == "b"


@FEW
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 5), st.text("ab", max_size=2))))
def test_dedup_is_idempotent_and_matches_brute_force(spark, data):
    df = versions(spark, [(i, T0 + h * HOUR, p) for i, h, p in data])
    once = latest_per_key(df, "id", "updated_at", ["payload"])
    best = {}
    for i, h, p in data:
        best[i] = max(best.get(i, (h, p)), (h, p))
    assert rows(once) == sorted(((i, T0 + h * HOUR, p) for i, (h, p) in best.items()), key=str)
    assert rows(latest_per_key(once, "id", "updated_at")) == rows(once)


def test_losers_are_dropped_before_the_shuffle(spark):
    df = versions(spark, [(1, T0, "a")])
    text = plan(latest_per_key(df, "id", "updated_at"))
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_unread_documents_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "feed")
    versions(spark, [(1, T0, "long document")]).withColumn("n", F.lit(1)).write.parquet(path)
    text = plan(latest_per_key(spark.read.parquet(path), "id", "updated_at").select("id", "n"))
    group_limit = next(line for line in text.splitlines() if "WindowGroupLimit" in line)
    assert "payload" not in group_limit


# numbering


def naive(df, column):
    order = Window.orderBy(F.col(column).asc_nulls_last())
    return df.select(column, F.row_number().over(order).cast("long").alias("k"))


@FEW
@given(st.sets(st.integers(-(2**62), 2**62), max_size=40), st.booleans())
def test_numbering_equals_the_single_window(spark, ids, with_null):
    data = [(i,) for i in ids] + ([(None,)] if with_null else [])
    df = spark.createDataFrame(data, "id bigint").repartition(5)
    assert rows(add_surrogate_key(df, "id", "k")) == rows(naive(df, "id"))


def test_numbering_over_many_partitions(spark):
    df = spark.range(0, 30_000, 1, 16).select((F.col("id") * 7919 % 30_011).alias("id"))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        keys = rank_ids(df, "id", "k", after=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wrong = keys.join(naive(df, "id").withColumnRenamed("k", "n"), "id").filter("k != n + 100")
    assert (keys.count(), wrong.count()) == (30_000, 0)


def test_text_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    assert rows(add_surrogate_key(df, "id", "k")) == [("a", 1), ("b", 2), ("c", 3)]


def test_rows_meet_their_keys_without_a_second_shuffle(spark):
    df = versions(spark, [(i, T0, "x") for i in range(100)])
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        keys = rank_ids(df.select("id").distinct(), "id", "k")
        text = plan(attach_keys(latest_per_key(df, "id", "updated_at"), keys, "id", "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text[text.index("SortMergeJoin") :]
    wide = join[: join.index("FileScan")]  # the side of the deduplicated rows
    assert wide.count("Exchange hashpartitioning(id") == 2  # one per join side
    assert "SinglePartition" not in wide


# incremental


def test_watermark_of_an_empty_target(spark):
    empty = versions(spark, [])
    assert watermark(empty, "updated_at").first()[0] == dt.datetime(1970, 1, 1)


def test_rows_at_the_watermark(spark):
    target = versions(spark, [(1, T0, "a")])
    feed = versions(spark, [(1, T0, "late"), (2, T0 + HOUR, "new"), (3, T0 - HOUR, "old")])
    assert [r.id for r in newer_than(feed, "updated_at", target, "updated_at").collect()] == [2]
    both = newer_than(feed, "updated_at", target, "updated_at", inclusive=True)
    assert sorted(r.id for r in both.collect()) == [1, 2]


def test_watermark_on_text_compares_time(spark):
    target = versions(spark, [(1, dt.datetime(2024, 1, 9), "a")])
    feed = spark.createDataFrame([("2024-01-10",), ("2024-1-9",), ("2024-1-8",)], "u string")
    assert [r.u for r in newer_than(feed, "u", target, "updated_at").collect()] == ["2024-01-10"]


def test_watermark_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "feed")
    versions(spark, [(1, T0, "a")]).write.parquet(path)
    feed = spark.read.parquet(path)
    text = newer_than(feed, "updated_at", feed, "updated_at")._jdf.queryExecution().toString()
    assert "GreaterThan(updated_at,2024-01-01T00:00)" in text


def test_watermark_keeps_microseconds_and_wall_clock(spark):
    at = T0 + dt.timedelta(microseconds=5)
    target = versions(spark, [(1, at, "a")])
    feed = versions(spark, [(1, at, "same"), (2, at + dt.timedelta(microseconds=1), "next")])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Riyadh")
    try:
        got = [r.id for r in newer_than(feed, "updated_at", target, "updated_at").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [2]


CURRENT = st.dictionaries(st.integers(1, 6), st.text("abc", max_size=2), max_size=6)


def keyed(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "id bigint, v string")


@FEW
@given(CURRENT, CURRENT, CURRENT)
def test_merge_laws(spark, old, first, second):
    target, a, b = keyed(spark, old), keyed(spark, first), keyed(spark, second)
    merged = upsert(target, a, "id")
    assert rows(merged) == rows(keyed(spark, {**old, **first}))
    assert rows(upsert(merged, a, "id")) == rows(merged)
    assert rows(upsert(upsert(target, a, "id"), b, "id")) == rows(
        upsert(target, keyed(spark, {**first, **second}), "id")
    )


def test_null_keys_never_match(spark):
    schema = "id bigint, v string"
    target = spark.createDataFrame([(None, "a"), (1, "b")], schema)
    source = spark.createDataFrame([(None, "c"), (1, "d")], schema)
    assert rows(upsert(target, source, "id")) == [(1, "d"), (None, "a"), (None, "c")]


def test_a_small_increment_does_not_shuffle_the_target(spark, tmp_path):
    target, source = str(tmp_path / "target"), str(tmp_path / "source")
    spark.range(100_000).withColumn("v", F.lit("x")).write.parquet(target)
    spark.range(3).withColumn("v", F.lit("y")).write.parquet(source)
    text = plan(upsert(spark.read.parquet(target), spark.read.parquet(source), "id"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


# joins


def skewed(spark, n=6000):
    """A third without license, a third on one license, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7))
    return spark.range(n).select(
        F.col("id").alias("PLANT"), key.otherwise(F.col("id") % 500).cast("bigint").alias("LIC")
    )


def test_spread_join_equals_plain_join(spark):
    left = skewed(spark)
    right = spark.range(100).select(F.col("id").alias("LIC"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "LIC", "left").select("LIC", "PLANT", "v")
    got = left_join_spread(left, right, "LIC", "PLANT").select("LIC", "PLANT", "v")
    assert rows(got) == rows(plain)


def test_hot_keys_are_split(spark):
    left = skewed(spark, 400_000).withColumn("text", F.repeat(F.lit("x"), F.lit(20)))
    right = spark.range(500).select(F.col("id").alias("LIC"), F.col("id").alias("v"))
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64kb",
    }
    try:
        for name, value in settings_.items():
            spark.conf.set(name, value)
        joined = left_join_spread(left, right, "LIC", "PLANT")
        # Rows without a key are on all reducers, not on one.
        nulls = joined.filter("LIC IS NULL").groupBy(F.spark_partition_id()).count()
        assert nulls.count() >= 8
        counted = joined.groupBy("v").count()
        assert {r.v: r["count"] for r in counted.collect()}[7] >= 400_000 // 3
        assert "skew=true" in plan(counted)
    finally:
        for name in settings_:
            spark.conf.unset(name)


# spines


def test_spine_has_both_ends_and_no_limit(spark):
    day = dt.date
    bounds = spark.createDataFrame(
        [(day(2010, 1, 1), day(2040, 12, 31))], "first_day date, last_day date"
    )
    days = date_spine(bounds)
    assert days.count() == (day(2040, 12, 31) - day(2010, 1, 1)).days + 1
    ends = days.agg(F.min("date_date"), F.max("date_date"), F.max("n")).first()
    assert tuple(ends) == (day(2010, 1, 1), day(2040, 12, 31), days.count() - 1)


def test_bounds_over_tables(spark):
    a = spark.createDataFrame([(T0,), (T0 + 48 * HOUR,)], "t timestamp_ntz")
    b = spark.createDataFrame([(dt.date(2023, 5, 1),), (None,)], "d date")
    assert tuple(date_bounds((a, "t"), (b, "d")).first()) == (
        dt.date(2023, 5, 1),
        dt.date(2024, 1, 3),
    )


# quality


def suite_table(spark):
    return spark.createDataFrame(
        [(1, "a", 5), (1, None, -1), (None, "a", 0), (None, "b", 2)], "k bigint, s string, n int"
    )


def test_checks(spark):
    df = suite_table(spark)
    assert quality.null_rows(df, "k").count() == 2
    assert rows(quality.duplicate_values(df, "k")) == [(1, 2)]
    assert rows(quality.duplicate_values(df, "k", "s")) == []
    assert quality.negative_rows(df, "n").count() == 1


def test_future_rows(spark):
    df = versions(spark, [(1, T0, "past"), (2, T0 + 24 * HOUR, "today"), (3, T0 + 48 * HOUR, "x")])
    today = F.lit(dt.date(2024, 1, 2))
    assert [r.id for r in quality.future_rows(df, "updated_at", today).collect()] == [3]


def test_report_and_failure(spark):
    checks = [
        quality.Check("t", "k", quality.NOT_NULL),
        quality.Check("t", "n", quality.NOT_NULL),
        quality.Check("t", "k", quality.UNIQUE),
    ]
    result = quality.report({"t": suite_table(spark)}, checks)
    assert rows(result) == [
        ("t", "k", "not_null", 2),
        ("t", "k", "unique", 1),
        ("t", "n", "not_null", 0),
    ]
    with pytest.raises(quality.QualityError, match=r"not_null\(t.k\): 2; unique\(t.k\): 1"):
        quality.require_clean(result)
    quality.require_clean(result.filter("failures = 0"))
    with pytest.raises(ValueError, match="unknown test"):
        quality.report({"t": suite_table(spark)}, [quality.Check("t", "k", "odd")])
