"""HTTP API reads: a data source with one request per partition, bodies as text."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stratalake.contracts import API_TIMEOUT
from stratalake.functions.payload import array_items, is_tabular
from stratalake.scratch import scratch_path, written
from stratalake.shipping import ship_package

# (method, url, headers, timeout in seconds) -> response text; raises on an HTTP error.
Fetch = Callable[[str, str, Mapping[str, str], int], str]

_SCHEMES = ("bearer ", "apikey ")


def http_fetch(method: str, url: str, headers: Mapping[str, str], timeout: int) -> str:
    request = urllib.request.Request(url, method=method, headers=dict(headers))
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read().decode(response.headers.get_content_charset() or "utf-8")


def auth_header(secret: str | None) -> dict[str, str]:
    """Authorization header of a stored secret: sent as it is when it names its
    scheme, else as a bearer token."""
    value = (secret or "").strip()
    if not value:
        return {}
    return {"Authorization": value if value.lower().startswith(_SCHEMES) else f"Bearer {value}"}


def request_headers(spark: SparkSession, endpoint: Mapping[str, Any]) -> dict[str, str]:
    """Headers of an endpoint entry, with the secret that its ``auth_variable``
    names in the session settings (stratalake.secret.<name>)."""
    name = endpoint.get("auth_variable")
    secret = spark.conf.get(f"stratalake.secret.{name}", "") if name else None
    return {**(endpoint.get("headers") or {}), **auth_header(secret)}


@dataclass
class Request(InputPartition):
    """One partition: one request."""

    position: int
    method: str
    url: str


class ApiReader(DataSourceReader):
    """A request per partition; its body is a row."""

    def __init__(self, requests: Sequence[Request], headers: Sequence[Mapping[str, str]], fetch: Fetch):
        self.requests, self.headers, self.fetch = list(requests), list(headers), fetch

    def partitions(self) -> list[Request]:
        # Spark reads a source without partitions as one partition, None.
        return self.requests

    def read(self, partition: Request | None) -> Iterator[tuple[int, str]]:
        if partition is None:
            return
        p = partition
        body = self.fetch(p.method, p.url, self.headers[p.position], API_TIMEOUT)
        json.loads(body)  # a response that is not JSON fails the load
        yield p.position, body


def api_format(
    spark: SparkSession,
    endpoints: Sequence[Mapping[str, Any]],
    fetch: Fetch = http_fetch,
    name: str = "stratalake_api",
) -> str:
    """Register the endpoints as a data source: ``spark.read.format(name).load()`` has the
    columns (position, body). The headers travel with the source, so that no secret is among
    its options or in a query plan. Returns the name."""
    ship_package(spark)
    headers = [request_headers(spark, e) for e in endpoints]
    requests = [Request(i, e.get("method") or "GET", e["url"]) for i, e in enumerate(endpoints)]

    class ApiSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "position int, body string"

        def reader(self, schema: StructType) -> ApiReader:
            return ApiReader(requests, headers, fetch)

    spark.dataSource.register(ApiSource)
    return name


def fetch_bodies(
    spark: SparkSession,
    endpoints: Sequence[Mapping[str, Any]],
    fetch: Fetch = http_fetch,
    parallel: int = 16,
) -> DataFrame:
    """(position, body) of every endpoint.

    An endpoint is requested once, but again if its task is retried or run twice by Spark:
    an endpoint with a method like POST must tolerate that.
    ``parallel`` bounds the requests in flight. Bodies are written out before
    use: a later stage, or a lost executor, does not call the API again.
    """
    # Loads that run side by side have endpoints of their own.
    name = api_format(spark, endpoints, fetch, f"stratalake_api_{uuid.uuid4().hex}")
    return written(spark.read.format(name).load().coalesce(parallel), "api-bodies")


def route(bodies: DataFrame) -> DataFrame:
    """Bodies with ``tabular``: true for a list of objects, false for a document."""
    return bodies.withColumn("tabular", is_tabular(F.col("body")))


def tabular_rows(bodies: DataFrame, schema: str | None = None) -> DataFrame:
    """Objects of list-of-objects bodies as rows. An element that is not an object
    fails the load.

    ``schema`` declares the columns, which saves a pass over the rows. Without it columns
    are all fields seen, in the order of first appearance, so one name per column comes
    to the driver, as many as the inferred schema has anyway; types are inferred over all
    rows. Names that differ only in case are two columns, which only a case-sensitive
    session can read again.
    """
    spark = bodies.sparkSession
    items = bodies.select(F.posexplode(array_items(F.col("body"))).alias("row", "item"))
    path = scratch_path(spark, "api-items")
    items.select("item").write.text(path)
    exact = spark.newSession()
    exact.conf.set("spark.sql.caseSensitive", "true")
    reader = exact.read.option("mode", "FAILFAST")
    if schema:
        return reader.schema(schema).json(path)
    rows = reader.json(path)
    fields = items.select("row", F.posexplode(F.json_object_keys("item")).alias("place", "field"))
    seen = fields.groupBy("field").agg(F.min(F.struct("row", "place")).alias("first"))
    order = [r.field for r in seen.orderBy("first").collect()]
    return rows.select(*[F.col(f"`{name}`") for name in order])
