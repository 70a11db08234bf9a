"""Written intermediates in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import logging
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
log = logging.getLogger(__name__)
_own: dict[str, str] = {}
_used: dict[str, str] = {}  # application -> folder that it has written to


def scratch_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only in local mode."""
    configured = spark.conf.get(SETTING, None)
    local = re.match(r"local($|\[)", spark.sparkContext.master)
    if configured:
        return configured.rstrip("/")
    if not local:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="stratalake-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    root = scratch_root(spark)
    if app not in _used:
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local["):
            log.warning("%s is %s: every executor must see that folder", SETTING, root)
        _used[app] = root
        atexit.register(_clear_at_exit, spark, app)
    return f"{root}/stratalake/{app}/{name}-{uuid.uuid4().hex}"


def _clear_at_exit(spark: SparkSession, app: str) -> None:
    """At the end of the program, while the session still runs."""
    context = spark.sparkContext
    if app in _used and getattr(context, "_jsc", None) is not None and context.applicationId == app:
        clear(spark)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written here; nothing if it has written nothing.

    A job's own error is worth more than one of its clean-up, which is only logged.
    """
    root = _used.pop(spark.sparkContext.applicationId, None)
    if root is None:
        return
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{root}/stratalake/{spark.sparkContext.applicationId}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception as error:
        log.warning("intermediates in %s were not deleted: %s", root, error)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of it.

    The scan has no lineage to ``df``: a lost executor re-reads files and never
    recomputes, so values that depend on partition numbers stay as they were.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
