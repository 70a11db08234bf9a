"""Queries over the benchmark tables, one per operator or model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake import contracts
from stratalake import fixtures as fx
from stratalake.functions import casts, labels, payload, status
from stratalake.functions.calendar import date_attributes
from stratalake.operators import quality
from stratalake.operators.dedup import latest_per_key
from stratalake.operators.incremental import newer_than, upsert, watermark
from stratalake.operators.joins import hot_keys, left_join_spread
from stratalake.operators.numbering import add_surrogate_key
from stratalake.operators.spine import date_bounds, date_spine
from stratalake.params import BuildParams
from stratalake.plans import bronze, gold, pipeline, silver
from stratalake.scratch import scratch_path, written
from stratalake.sinks import files, landing as sink
from stratalake.sinks.folders import layer_rows
from stratalake.sinks.tables import Lake, merge_table, replace_table
from stratalake.sources import landing as source
from stratalake.sources.mixed import mixed_rows

Query = Callable[[SparkSession, str], DataFrame]

# Whole builds number their rows; a mart alone does not need the keys.
PARAMS = BuildParams(as_of=fx.AS_OF)
MART_ONLY = BuildParams(as_of=fx.AS_OF, number_rows=False)
WITH_META = BuildParams(as_of=fx.AS_OF, read_meta=True)
RESTART = BuildParams(as_of=fx.AS_OF, restart_keys=True)

# The bodies have line breaks; JSON text never holds this character.
RECORD_SEPARATOR = "\x1e"

DQ_CHECKS = (
    quality.Check("plants", "id", quality.NOT_NULL),
    quality.Check("plants", "license_id", quality.NOT_NULL),
    quality.Check("plants", "land_provider", quality.NOT_NULL),
    quality.Check("plants", "id", quality.UNIQUE),
    quality.Check("plants", "license_id", quality.UNIQUE),
    quality.Check("licenses", "expires_at", quality.NOT_NULL),
    quality.Check("licenses", "id", quality.UNIQUE),
    quality.Check("lineitem", "l_orderkey", quality.NOT_NULL),
    quality.Check("lineitem", "l_orderkey", quality.UNIQUE),
)


# models


def stg_plants(spark: SparkSession, d: str) -> DataFrame:
    return bronze.stg_plants(fx.plants_feed(spark, d), PARAMS)


def stg_plants_meta(spark: SparkSession, d: str) -> DataFrame:
    """Plants whose meta columns are read from the meta document."""
    return bronze.stg_plants(fx.plants_feed(spark, d), WITH_META)


def stg_licenses(spark: SparkSession, d: str) -> DataFrame:
    return bronze.stg_licenses(fx.licenses(spark, d), PARAMS)


def stg_plants_incremental(spark: SparkSession, d: str) -> DataFrame:
    """First run up to the split, then an incremental run over the whole feed."""
    first = written(bronze.stg_plants(fx.feed_until_split(spark, d), PARAMS), "first-run")
    rows = bronze.stg_plants(fx.plants_feed(spark, d), PARAMS, target=first)
    return upsert(first, written(rows, "increment"), "PLANT_ID")


def stg_plants_restart(spark: SparkSession, d: str) -> DataFrame:
    """The increment alone, numbered from 1."""
    first = bronze.stg_plants(fx.feed_until_split(spark, d), MART_ONLY)
    return bronze.stg_plants(fx.plants_feed(spark, d), RESTART, target=first)


def stg_licenses_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Licenses whose integers landed as doubles."""
    return bronze.stg_licenses(casts.promote_integers(fx.licenses(spark, d)), PARAMS)


def dim_plant_profile(spark: SparkSession, d: str) -> DataFrame:
    return silver.dim_plant_profile(
        bronze.stg_plants(fx.plants(spark, d), PARAMS),
        bronze.stg_licenses(fx.licenses(spark, d), PARAMS),
    )


def dm_plant(spark: SparkSession, d: str) -> DataFrame:
    return gold.dm_plant(
        silver.dim_plant_profile(
            bronze.stg_plants(fx.plants(spark, d), MART_ONLY),
            bronze.stg_licenses(fx.licenses(spark, d), MART_ONLY),
        )
    )


def pipeline_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Landing to mart through an incremental plant load."""
    return gold.dm_plant(
        silver.dim_plant_profile(
            stg_plants_incremental(spark, d), bronze.stg_licenses(fx.licenses(spark, d), PARAMS)
        )
    )


# calendar


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return date_bounds(
        (fx.table(spark, d, "orders"), "o_orderdate"),
        (fx.table(spark, d, "lineitem"), "l_shipdate"),
        (fx.table(spark, d, "events"), "ts"),
    )


def dim_date(spark: SparkSession, d: str) -> DataFrame:
    return silver.dim_date(_bounds(spark, d))


def digits_spine(spark: SparkSession, d: str) -> DataFrame:
    return date_spine(_bounds(spark, d))


def date_parts_on_orders(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select(
        "o_orderkey", *date_attributes(F.col("o_orderdate").cast("date"))
    )


def fact_by_calendar(spark: SparkSession, d: str) -> DataFrame:
    return gold.count_by_calendar(
        fx.table(spark, d, "orders"),
        "o_orderdate",
        dim_date(spark, d),
        "year_num",
        "month_num",
        "day_name_long",
        "is_weekend",
    )


# single operators


def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(fx.table(spark, d, "events"), "user_id", "ts")


def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    return add_surrogate_key(fx.table(spark, d, "orders"), "o_orderkey", "order_key")


def target_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Watermark of the events, and of a target without rows."""
    events = fx.table(spark, d, "events")
    empty = events.filter(F.lit(False))
    return (
        watermark(events, "ts")
        .select(F.lit("events").alias("target"), "watermark")
        .unionByName(watermark(empty, "ts").select(F.lit("empty").alias("target"), "watermark"))
    )


def incremental_watermark(spark: SparkSession, d: str) -> DataFrame:
    events = fx.table(spark, d, "events")
    return newer_than(events, "ts", events.filter(fx.before_split("ts")), "ts")


def incremental_inclusive(spark: SparkSession, d: str) -> DataFrame:
    events = fx.table(spark, d, "events")
    return newer_than(events, "ts", events.filter(fx.before_split("ts")), "ts", inclusive=True)


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    events = fx.table(spark, d, "events")
    before = fx.before_split("ts")
    target = latest_per_key(events.filter(before), "user_id", "ts")
    source_rows = latest_per_key(events.filter(~before), "user_id", "ts")
    return upsert(target, written(source_rows, "merge-source"), "user_id")


def merge_into_folders(spark: SparkSession, d: str) -> DataFrame:
    """The same merge into a table in folders, after a first merge of a few keys."""
    events = fx.table(spark, d, "events")
    before = fx.before_split("ts")
    lake = Lake(scratch_path(spark, "lake"), folders=16)
    table = f"default.merge_{uuid.uuid4().hex}"
    stored = written(latest_per_key(events.filter(before), "user_id", "ts"), "merge-target")
    replace_table(stored.filter("user_id % 3 <> 0"), lake, table, "user_id")
    merge_table(stored.filter("user_id % 3 = 0"), lake, table, "user_id")
    merge_table(latest_per_key(events.filter(~before), "user_id", "ts"), lake, table, "user_id")
    merged = written(layer_rows(spark, table), "merged")
    spark.sql(f"DROP TABLE {table}")  # the entry only; the files have a given path
    return merged


def join_hot_licenses(spark: SparkSession, d: str) -> DataFrame:
    """Plants of which half have one license, with the dates of their licenses."""
    license = F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("license_id"))
    plants = written(fx.plants(spark, d).select("id", license.alias("license_id")), "hot-plants")
    theirs = fx.licenses(spark, d).select(F.col("id").alias("license_id"), "expires_at", "investor_id")
    return left_join_spread(plants, theirs, "license_id", "id", hot_keys(plants, "license_id"))


def map_state_label(spark: SparkSession, d: str) -> DataFrame:
    return fx.plants_feed(spark, d).select(
        "id", "updated_at", "state", labels.state_label(F.col("state")).alias("plant_status_ar")
    )


def map_provider_label(spark: SparkSession, d: str) -> DataFrame:
    return fx.plants_feed(spark, d).select(
        "id",
        "updated_at",
        "land_provider",
        labels.provider_label(F.col("land_provider")).alias("land_provider_ar"),
    )


def license_cycle(spark: SparkSession, d: str) -> DataFrame:
    return fx.licenses(spark, d).select(
        "id", status.license_cycle(PARAMS.today()).alias("LICENSE_CYCLE")
    )


def license_status(spark: SparkSession, d: str) -> DataFrame:
    return fx.licenses(spark, d).select(
        "id", status.license_status(PARAMS.today()).alias("license_status")
    )


def blank_to_null_cast(spark: SparkSession, d: str) -> DataFrame:
    feed = fx.plants_feed(spark, d)
    return feed.select(
        "id",
        "updated_at",
        casts.blank_to_number(feed, "number", "bigint").alias("plant_number"),
        casts.blank_to_number(feed, "main_activity_code_l2", "int").alias("code_l2"),
        casts.blank_to_number(feed, "main_activity_code_l4", "int").alias("code_l4"),
    )


def nullif_cast(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.licenses(spark, d)
    number = casts.empty_to_number(rows, "number", "bigint")
    return rows.select("id", number.alias("license_number"))


def cast_columns(spark: SparkSession, d: str) -> DataFrame:
    """Text and numbers to the model types and back."""
    rows = fx.table(spark, d, "lineitem").withColumn(
        "shipped", F.col("l_shipdate").cast("string")
    )
    return rows.select(
        F.col("l_orderkey").cast("string").alias("order_text"),
        F.col("l_orderkey").cast("string").cast("bigint").alias("order_number"),
        F.col("l_partkey").cast("int").alias("part_int"),
        F.col("l_linenumber").cast("bigint").alias("line_long"),
        casts.to_timestamp(rows, "shipped").alias("shipped_at"),
        F.col("shipped").cast("date").alias("shipped_on"),
    )


def typed_null_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return fx.plants(spark, d).select("id", *casts.typed_nulls(contracts.PLANT_META))


def meta_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A number and a text that a third of the documents lack."""
    area = F.concat(F.lit('{"area": "zone '), F.col("event_id") % 50, F.lit('", '))
    with_area = F.concat(area, F.expr("substring(props, 2)"))
    document = F.when(F.col("event_id") % 3 != 0, with_area).otherwise(F.col("props"))
    fields = payload.extract_fields(document, {"k": "bigint", "area": "string"})
    return fx.table(spark, d, "events").withColumn("f", fields).select("event_id", "f.k", "f.area")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """API-like bodies of all shapes, made from the event documents."""
    e, props = F.col("event_id") % 6, F.col("props")
    body = (
        F.when(e == 0, F.concat(F.lit("["), props, F.lit("]")))
        .when(e == 1, F.concat(F.lit(" [\n "), props, F.lit(",\n"), props, F.lit("]")))
        .when(e == 2, F.lit("[]"))
        .when(e == 3, F.concat(F.lit("[1, "), props, F.lit("]")))
        .when(e == 4, F.lit('["{x"]'))
        .otherwise(props)
    )
    return fx.table(spark, d, "events").select("event_id", body.alias("body"))


def json_shape_route(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).withColumn("tabular", payload.is_tabular(F.col("body")))


def json_tabular_rows(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the tabular bodies as typed rows."""
    items = payload.typed_items(F.col("body"), {"k": "bigint"})
    return (
        _bodies(spark, d)
        .filter(payload.is_tabular(F.col("body")))
        .select("event_id", F.posexplode(items).alias("row", "item"))
        .select("event_id", "row", "item.k")
    )


def json_mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    """All items of bodies of all shapes, with a field that is a number here and a text there."""
    body = F.regexp_replace("body", r'"k": (\d+)', '"k": "n$1"')
    bodies = _bodies(spark, d).withColumn(
        "body", F.when(F.col("event_id") % 5 == 0, body).otherwise(F.col("body"))
    )
    return mixed_rows(bodies, ["event_id"]).select("event_id", "row", "kind", "value", "fields.k")


# landing


def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return source.scan(spark, f"{d}/orders.parquet", fx.SCHEMAS["orders"])


def landing_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "roundtrip")
    rows = fx.table(spark, d, "customer")
    sink.write_snapshot(rows, path)
    return source.scan(spark, path, rows.schema)


def records_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "records")
    rows = fx.table(spark, d, "orders")
    sink.write_records(rows, path)
    return spark.read.schema(rows.schema).json(path)


def documents_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    sink.write_documents(_bodies(spark, d), "body", path, RECORD_SEPARATOR)
    return source.read_documents(spark, path, RECORD_SEPARATOR)


def record_arrays_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders through files that are whole JSON arrays, several of them from some size on."""
    path = scratch_path(spark, "arrays")
    rows = fx.table(spark, d, "orders")
    parts = max(4, rows.count() // 1_000_000)
    files.write_record_arrays(rows.repartition(parts, "o_orderkey"), path, one_file_rows=10_000)
    return files.read_record_arrays(spark, path, rows.schema)


def files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Event documents in named files of a thousand each, written and read back."""
    path = scratch_path(spark, "files")
    events = fx.table(spark, d, "events").select("event_id", "props")
    line = F.concat_ws("\t", "event_id", "props")
    whole = events.groupBy(F.expr("event_id div 1000").alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text")
    )
    name = F.concat(F.lit("day/events-"), "part", F.lit(".tsv"))
    files.write_files(whole.select(name.alias("name"), F.encode("text", "utf-8").alias("content")), path)
    lines = files.read_files(spark, path).select(
        "name", F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")
    )
    return lines.select(
        "name",
        F.substring_index("line", "\t", 1).cast("bigint").alias("event_id"),
        F.substring_index("line", "\t", -1).alias("props"),
    )


def promote_integers(spark: SparkSession, d: str) -> DataFrame:
    return casts.promote_integers(fx.table(spark, d, "customer"))


def ordered_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "ordered")
    rows = fx.table(spark, d, "orders")
    sink.write_snapshot(sink.in_key_order(rows, "o_orderkey"), path)
    return source.scan(spark, path, rows.schema)


def load_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """What landing each table reports, counted while it is written."""
    rows = {
        name: sink.write_snapshot(fx.table(spark, d, name), scratch_path(spark, f"load-{name}"))
        for name in fx.SCHEMAS
    }
    return sink.counts_of(rows, spark)


# data quality


def dq_not_null(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_rows(fx.plants(spark, d), "license_id").select("id", "license_id", "state")


def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_values(fx.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def dq_no_future_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.future_rows(fx.licenses(spark, d), "expires_at", PARAMS.today())
    return rows.select("id", "expires_at")


def dq_no_negative_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.negative_rows(fx.table(spark, d, "customer"), "c_acctbal")


def dq_report(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "plants": fx.plants(spark, d),
        "licenses": fx.licenses(spark, d),
        "lineitem": fx.table(spark, d, "lineitem"),
    }
    return quality.report(tables, DQ_CHECKS)


def dq_suite(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the pipeline over all landed and built tables."""
    plants, licenses = fx.plants(spark, d), fx.licenses(spark, d)
    # Each model is computed once and stored, as in a build; the checks scan the files.
    stage = written(bronze.stg_plants(plants, MART_ONLY), "stg_plants")
    license_stage = written(bronze.stg_licenses(licenses, MART_ONLY), "stg_licenses")
    profile = written(silver.dim_plant_profile(stage, license_stage), "profile")
    tables = {
        "plants": plants,
        "licenses": licenses,
        "stg_plants": stage,
        "stg_licenses": license_stage,
        "dw_dim_plant_profile": profile,
        "dw_dim_date": written(dim_date(spark, d), "calendar"),
        "dm_plant": gold.dm_plant(profile),
    }
    return quality.report(tables, pipeline.CHECKS)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        dm_plant, dim_plant_profile, stg_plants, stg_plants_meta, stg_licenses, stg_plants_incremental,
        stg_plants_restart, stg_licenses_promoted, pipeline_end_to_end, dim_date, digits_spine, date_parts_on_orders, fact_by_calendar,
        dedup_latest, surrogate_key, target_watermark, incremental_watermark, incremental_inclusive,
        merge_upsert, merge_into_folders, join_hot_licenses,
        map_state_label, map_provider_label, license_cycle, license_status,
        blank_to_null_cast, nullif_cast, cast_columns, typed_null_placeholders,
        meta_json_extract, json_shape_route, json_tabular_rows, json_mixed_rows, scan_parquet,
        landing_roundtrip, records_roundtrip, documents_roundtrip,
        record_arrays_roundtrip, files_roundtrip, promote_integers, ordered_export, load_row_counts,
        dq_not_null, dq_unique, dq_no_future_dates, dq_no_negative_counts, dq_report,
        dq_suite,
    )
}
