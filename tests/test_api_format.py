"""Endpoints as a data source."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalake.sources import api


def counting(path, fail_at=None):
    """Answers with the request, and notes each in a file; of its own scope, to travel by value."""
    file = str(path)

    def call(method, url, headers, timeout):
        import json

        from pyspark import TaskContext

        with open(file, "a") as log:
            log.write(json.dumps([url, TaskContext.get().partitionId()]) + "\n")
        if url == fail_at:
            raise OSError("503")
        return json.dumps({"url": url, "method": method, **headers})

    return call


def noted(path):
    return [tuple(json.loads(line)) for line in path.read_text().splitlines()]


def endpoints(n):
    return [{"url": f"u/{i}", "key": f"k{i}", "method": "POST" if i % 2 else None} for i in range(n)]


def test_one_request_per_partition(spark, tmp_path):
    log = tmp_path / "log"
    name = api.api_format(spark, endpoints(7), counting(log), "api_test")
    rows = spark.read.format(name).load()
    assert rows.dtypes == [("position", "int"), ("body", "string")]
    assert rows.rdd.getNumPartitions() == 7 and not log.exists()  # planning sends nothing
    found = {r.position: json.loads(r.body) for r in rows.collect()}
    assert found == {i: {"url": f"u/{i}", "method": "POST" if i % 2 else "GET"} for i in range(7)}
    assert Counter(noted(log)) == {(f"u/{i}", i): 1 for i in range(7)}


def test_fetch_bodies_reads_the_source_once(spark, tmp_path):
    log = tmp_path / "log"
    fetch = counting(log)
    bodies = api.fetch_bodies(spark, endpoints(9), fetch, parallel=2)
    assert {p for _, p in noted(log)} == {0, 1}  # two tasks, each with its share
    name = api.api_format(spark, endpoints(9), counting(tmp_path / "other"), "api_again")
    same = spark.read.format(name).load()
    assert sorted(bodies.collect()) == sorted(same.collect())
    assert bodies.filter("position < 3").count() == 3 and bodies.count() == 9
    assert Counter(url for url, _ in noted(log)) == {f"u/{i}": 1 for i in range(9)}


def test_a_failing_request_fails_the_read(spark, tmp_path):
    name = api.api_format(spark, endpoints(3), counting(tmp_path / "log", "u/1"), "api_broken")
    with pytest.raises(Exception, match="503"):
        spark.read.format(name).load().collect()


def test_sources_side_by_side(spark, tmp_path):
    one = spark.read.format(api.api_format(spark, endpoints(2), counting(tmp_path / "a"), "api_one")).load()
    two = spark.read.format(api.api_format(spark, endpoints(3), counting(tmp_path / "b"), "api_two")).load()
    assert (one.count(), two.count()) == (2, 3)


def test_secrets_are_neither_in_the_plan_nor_among_the_options(spark, tmp_path):
    spark.conf.set("stratalake.secret.token", "s3cr3t")
    try:
        entries = [{"url": "u", "key": "k", "auth_variable": "token"}]
        name = api.api_format(spark, entries, counting(tmp_path / "log"), "api_secret")
    finally:
        spark.conf.unset("stratalake.secret.token")
    rows = spark.read.format(name).load()
    assert "s3cr3t" not in rows._jdf.queryExecution().toString()
    body = rows.select(F.get_json_object("body", "$.Authorization").alias("a")).first()
    assert body.a == "Bearer s3cr3t"


def test_no_endpoints(spark):
    name = api.api_format(spark, [], counting("/dev/null"), "api_none")
    assert spark.read.format(name).load().collect() == []
