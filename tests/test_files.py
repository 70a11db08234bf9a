"""JSON arrays and named files."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalake.sinks.files import (
    FORMAT,
    FilesSource,
    read_files,
    read_record_arrays,
    write_files,
    write_record_arrays,
)


def documents(path):
    return [json.loads(p.read_text()) for p in sorted(Path(path).glob("part-*"))]


def names(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_one_array_of_all_records(spark, tmp_path):
    rows = [(1, "a\n\"b\"", dt.datetime(2024, 1, 2, 3, 4, 5), None), (2, None, None, [1, 2])]
    df = spark.createDataFrame(rows, "id bigint, v string, `at` timestamp_ntz, list array<int>")
    assert write_record_arrays(df.repartition(3), str(tmp_path / "a")) == 2
    (array,) = documents(tmp_path / "a")
    assert sorted(array, key=lambda r: r["id"]) == [
        {"id": 1, "v": "a\n\"b\"", "at": "2024-01-02T03:04:05.000", "list": None},
        {"id": 2, "v": None, "at": None, "list": [1, 2]},
    ]
    back = read_record_arrays(spark, str(tmp_path / "a"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_many_records_are_arrays_of_their_own(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).selectExpr("id", "id % 7 AS `a b`")
    write_record_arrays(df, str(tmp_path / "a"), one_file_rows=100)
    arrays = documents(tmp_path / "a")
    assert len(arrays) == 4 and sorted(r["id"] for a in arrays for r in a) == list(range(5000))


def test_no_array_is_larger_than_a_read_should_be(spark, tmp_path):
    """However few partitions there are; the arrays follow the order of the frame."""
    df = spark.range(0, 20_000, 1, 2).selectExpr("id", "repeat('x', 80) AS v")
    write_record_arrays(df, str(tmp_path / "a"), one_file_rows=100, file_bytes=200_000)
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert 10 <= len(sizes) <= 12 and max(sizes) < 1.3 * 200_000
    assert [r["id"] for a in documents(tmp_path / "a") for r in a] == list(range(20_000))
    back = read_record_arrays(spark, str(tmp_path / "a"), df.schema)
    assert sorted(r.id for r in back.collect()) == list(range(20_000))


def test_an_empty_frame_is_an_empty_array(spark, tmp_path):
    df = spark.createDataFrame([], "id bigint")
    assert write_record_arrays(df, str(tmp_path / "a")) == 0
    assert documents(tmp_path / "a") == [[]]
    assert read_record_arrays(spark, str(tmp_path / "a"), df.schema).collect() == []


def test_a_failed_load_keeps_the_former_array(spark, tmp_path):
    path = str(tmp_path / "a")
    write_record_arrays(spark.range(3), path)
    with pytest.raises(Exception):
        write_record_arrays(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert documents(path) == [[{"id": 0}, {"id": 1}, {"id": 2}]]


def frame(spark, *rows):
    return spark.createDataFrame(rows, "name string, content binary")


def test_files_as_they_are(spark, tmp_path):
    rows = [("a.json", b"{}"), ("sub/b.gz", bytes(range(256))), ("c", b""), ("d", None)]
    assert write_files(frame(spark, *rows), str(tmp_path / "f")) == 4
    assert names(tmp_path / "f") == ["a.json", "c", "d", "sub/b.gz"]
    found = {r.name: bytes(r.content) for r in read_files(spark, str(tmp_path / "f")).collect()}
    assert found == {name: content for name, content in rows if content}
    assert (tmp_path / "f" / "c").read_bytes() == (tmp_path / "f" / "d").read_bytes() == b""


def test_a_write_replaces_the_folder(spark, tmp_path):
    path = str(tmp_path / "f")
    write_files(frame(spark, ("a", b"1"), ("b", b"2")), path)
    write_files(frame(spark, ("b", b"3")), path)
    assert names(path) == ["b"] and names(tmp_path) == ["f/b"]


def failing(spark):
    """One file of each task, and one task that fails after its file."""
    return spark.range(0, 8, 1, 8).select(
        F.concat(F.lit("f"), "id").alias("name"),
        F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"),
    )


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "f")
    write_files(frame(spark, ("a", b"1")), path)
    with pytest.raises(Exception):
        write_files(failing(spark), path)
    assert names(tmp_path) == ["f/a"]


def test_the_format_by_itself(spark, tmp_path):
    spark.dataSource.register(FilesSource)
    path = str(tmp_path / "f")
    save = lambda df, mode: df.write.format(FORMAT).mode(mode).save(path)
    save(frame(spark, ("a", b"1"), ("sub/b", b"2")), "append")
    save(frame(spark, ("c", b"3")), "append")
    assert names(path) == ["a", "c", "sub/b"]
    with pytest.raises(Exception):
        save(failing(spark), "append")
    assert names(path) == ["a", "c", "sub/b"]
    save(frame(spark, ("e", b"5")), "overwrite")
    assert names(path) == ["e"]


@pytest.mark.parametrize("rows", [[("a", b"1"), ("a", b"2")], [("../a", b"")], [("", b"")], [(None, b"")], [("/a", b"")]])
def test_names_that_are_refused(spark, tmp_path, rows):
    with pytest.raises(Exception):
        write_files(frame(spark, *rows), str(tmp_path / "f"))
    assert names(tmp_path) == []


def test_columns_that_are_refused(spark, tmp_path):
    spark.dataSource.register(FilesSource)
    with pytest.raises(Exception, match="files have a name"):
        spark.range(1).write.format(FORMAT).mode("append").save(str(tmp_path / "f"))
