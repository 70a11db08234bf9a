"""Whole files: JSON arrays, and files whose names and bytes are rows.

JSON arrays go through Spark's text writer, so any file system that Spark knows will do and
its committer keeps files of failed tasks out. Named files have no writer in Spark; they are a
data source of their own, whose tasks write beside the target and whose commit, once all
tasks are done, moves the files to their names. A failed job leaves nothing.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from stratalake.scratch import written
from stratalake.shipping import ship_package
from stratalake.sinks.landing import ISO_TIMESTAMP, replace_folder, with_count

# Records of up to so many rows are one file; more are one file per partition, or, beyond so many
# bytes in all, files of about as many bytes each.
ONE_FILE_ROWS = 1_000_000
FILE_BYTES = 128 << 20
NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.=-]*(/[A-Za-z0-9_][A-Za-z0-9_.=-]*)*")
FORMAT = "stratalake_files"


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON objects of a partition as the lines of one array, a batch at a time."""
    line = lambda items: pa.RecordBatch.from_arrays([pa.array(items, pa.string())], ["line"])
    opened = False
    for batch in batches:
        items = batch.column(0).to_pylist()
        if not items:
            continue
        if not opened:
            items[0] = "[" + items[0]
            opened = True
        else:
            items[0] = "," + items[0]
        yield line([items[0], *("," + item for item in items[1:])])
    yield line(["]" if opened else "[]"])


def write_record_arrays(
    df: DataFrame, path: str, one_file_rows: int = ONE_FILE_ROWS, file_bytes: int = FILE_BYTES
) -> int:
    """Replace the dataset at ``path`` by JSON arrays of records and return the row count.

    Every file is one whole array; up to ``one_file_rows`` rows are one file, in the order of
    the frame, as they pass through one task. More rows are files of about ``file_bytes`` at most,
    however few the partitions are, as a file is also read by one task. Dates are ISO text, NULL
    fields are kept, an empty frame is ``[]``.
    """
    spark = df.sparkSession
    ship_package(spark)
    options = {
        "timestampFormat": ISO_TIMESTAMP + "XXX",
        "timestampNTZFormat": ISO_TIMESTAMP,
        "ignoreNullFields": "false",
    }
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options)
    place = F.monotonically_increasing_id().alias("place")
    seen = Observation()
    size = F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).alias("bytes")
    placed = df.select(record.alias("record"), place)
    records = written(placed.observe(seen, F.count(F.lit(1)).alias("rows"), size), "records")
    rows, total = seen.get["rows"], seen.get["bytes"] + 2 * seen.get["rows"]  # with comma and line end
    if rows <= one_file_rows:
        whole = records.coalesce(1)
    elif total <= file_bytes:
        whole = records
    else:
        files = max(math.ceil(total / file_bytes), records.rdd.getNumPartitions())
        whole = records.repartitionByRange(files, "place")
    whole = whole.sortWithinPartitions("place").select("record")

    def write(folder: str) -> int:
        lines = whole.mapInArrow(_arrays, "line string")
        lines.write.option("maxRecordsPerFile", 0).text(folder)
        return rows

    return replace_folder(spark, path, write)


def read_record_arrays(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON arrays; a file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


@dataclass
class _Written(WriterCommitMessage):
    """Names of the files that a task has staged in ``folder``."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Stages files in a hidden folder of the target, one folder per task attempt.

    The hidden folder is made once: a task that is still running when the job is aborted finds
    it gone and cannot bring it back.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.staging = f".staged-{uuid.uuid4().hex}"
        system, root = self._place()
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def _place(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.root))
        return fs.LocalFileSystem(), self.root

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, root = self._place()
        task = TaskContext.get()
        folder = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(f"{root}/{folder}", recursive=False)
        names = []
        for row in iterator:
            if not NAME.fullmatch(row.name or ""):
                raise ValueError(f"not a file name: {row.name!r}")
            target = f"{root}/{folder}/{row.name}"
            for part in list(accumulate(row.name.split("/")[:-1], "{}/{}".format)):
                system.create_dir(f"{root}/{folder}/{part}", recursive=False)
            with system.open_output_stream(target, compression=None) as out:
                out.write(bytes(row.content or b""))
            names.append(row.name)
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = self._place()
        moves = {}
        for message in filter(None, messages):
            for name in message.names:
                if name in moves:
                    self.abort(messages)
                    raise ValueError(f"two files are named {name}")
                moves[name] = f"{root}/{message.folder}/{name}"
        if self.overwrite:
            for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if entry.base_name != self.staging:
                    (system.delete_dir if entry.type == fs.FileType.Directory else system.delete_file)(entry.path)
        for name, staged in moves.items():
            system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            system.move(staged, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class FilesSource(DataSource):
    """``df.write.format("stratalake_files").save(path)`` for (name, content) rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds != {"name": "string", "content": "binary"}:
            raise ValueError(f"files have a name (string) and content (binary), not {kinds}")
        return FilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str) -> int:
    """Replace the folder at ``path`` by a file for each (name, content) and return how many.

    Names may have folders; two equal ones fail the write. Files are as large as a row may be.
    The file systems are those of Arrow: local, hdfs, s3, gs, abfs.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(FilesSource)

    def write(folder: str) -> int:
        watched, seen = with_count(df.select(F.col("name").cast("string"), F.col("content").cast("binary")))
        watched.write.format(FORMAT).mode("append").save(folder)
        return seen.get["rows"]

    return replace_folder(spark, path, write)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files below ``path``; names are relative to it. Spark skips
    files without content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = path.rstrip("/").rpartition("/")[2]
    name = F.substring_index("path", f"/{folder}/", -1)
    return rows.select(name.alias("name"), "content")
