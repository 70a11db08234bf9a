"""Config-driven copies into the landing layer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.parallel import run_all
from stratalake.params import BuildParams
from stratalake.sinks.landing import (
    check_apart,
    check_identifier,
    document_key,
    parquet_key,
    table_path,
    write_documents,
    write_snapshot,
)
from stratalake.sources.api import Fetch, fetch_bodies, http_fetch, route, tabular_rows
from stratalake.sources.jdbc import MAX_READS, ROW, ROWS_PER_READ, connection, read_table

TABLE_KEYS = ("schema", "table")
MYSQL_TABLE_KEYS = ("mysql_schema", "mysql_table")
ENDPOINT_KEYS = ("url", "key")

@dataclass(frozen=True)
class Loaded:
    """A finished copy: where it is and how many rows it has."""

    path: str
    rows: int


def table_entry(entry: Mapping[str, Any], dialect: str) -> tuple[str, str, str | None]:
    """(schema, table, primary key) of a config entry. Only MySQL may set an empty
    key, which means an unordered read."""
    mysql = dialect == "mysql"
    schema_key, name_key = MYSQL_TABLE_KEYS if mysql else TABLE_KEYS
    schema = check_identifier(entry[schema_key], schema_key)
    table = check_identifier(entry[name_key], name_key)
    key = entry.get("primary_key", "id") or None
    if key or not mysql:
        check_identifier(key, "primary_key")
    return schema, table, key


def ingest_tables(
    spark: SparkSession,
    dialect: str,
    entries: Sequence[Mapping[str, Any]],
    landing_root: str,
    default_conn: str,
    prefix: str | None = None,
    params: BuildParams = BuildParams(),
    read: Callable[..., DataFrame] | None = None,
    rows_per_read: int = ROWS_PER_READ,
    max_reads: int = MAX_READS,
) -> list[Loaded]:
    """Copy every configured table to landing; each copy replaces its snapshot.

    ``read(spark, conn_id, schema, table, primary_key)`` replaces the database
    read, e.g. by files of an export. An entry's ``split_by`` names an integer column
    that splits what the key cannot; without one that is split by the identity of rows, or
    not at all if it is empty, as views need it. ``as_of`` (ISO time) and ``changed_at`` (a
    column) let all reads of a table see one state.
    """
    options = {table_entry(e, dialect)[:2]: e for e in entries}

    def from_database(spark, conn_id, schema, table, key):
        source = connection(spark, dialect, conn_id)
        entry = options[schema, table]
        at = dt.datetime.fromisoformat(entry["as_of"]) if entry.get("as_of") else None
        return read_table(
            spark, source, schema, table, key, rows_per_read, max_reads,
            entry.get("split_by", ROW) or None, at, entry.get("changed_at"),
        )

    source = read or from_database
    names = [table_entry(entry, dialect)[:2] for entry in entries]
    check_apart([table_path(landing_root, *name, prefix) for name in names])

    def copy(entry: Mapping[str, Any]) -> Loaded:
        schema, table, key = table_entry(entry, dialect)
        rows = source(spark, entry.get("conn_id") or default_conn, schema, table, key)
        path = table_path(landing_root, schema, table, prefix)
        return Loaded(path, write_snapshot(rows, path, params.promote_integers))

    return run_all(spark, copy, entries)


def ingest_apis(
    spark: SparkSession,
    endpoints: Sequence[Mapping[str, Any]],
    landing_root: str,
    fetch: Fetch = http_fetch,
) -> list[Loaded]:
    """Copy every configured endpoint to landing: a list of objects as Parquet
    (unless the entry asks for json), anything else as one JSON document. Keys are
    checked before any request is sent."""
    if not endpoints:
        return []
    root = landing_root.rstrip("/")
    keys = [(parquet_key(e["key"]), document_key(e["key"])) for e in endpoints]
    for i, pair in enumerate(keys):
        # Which of its two paths an endpoint takes depends on the response.
        for other in keys[i + 1 :]:
            for one in pair:
                for two in other:
                    check_apart([one, two])
    bodies = route(fetch_bodies(spark, endpoints, fetch))
    # One flag per configured endpoint.
    tabular = {r.position: r.tabular for r in bodies.select("position", "tabular").collect()}

    def store(position: int) -> Loaded:
        endpoint = endpoints[position]
        body = bodies.filter(F.col("position") == position)
        dataset, document = (f"{root}/{key}" for key in keys[position])
        if tabular[position] and endpoint.get("output_format", "parquet") != "json":
            rows = tabular_rows(body, endpoint.get("schema"))
            if rows.columns:  # objects without any field stay a document
                return Loaded(dataset, write_snapshot(rows, dataset))
        return Loaded(document, write_documents(body, "body", document))

    return run_all(spark, store, range(len(endpoints)))
