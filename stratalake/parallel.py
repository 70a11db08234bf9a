"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Copies or models submitted at a time; their tasks share the executors.
PARALLEL_JOBS = 4

Item = TypeVar("Item")
Result = TypeVar("Result")


class JobsFailed(Exception):
    """One or more jobs failed; the others were completed."""


def run_all(
    spark: SparkSession, job: Callable[[Item], Result], items: Sequence[Item]
) -> list[Result]:
    """Results of ``job`` for every item, in order. All run even if one fails."""
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job), i) for i in items]
    failed = [(i, f.exception()) for i, f in zip(items, futures) if f.exception()]
    if len(failed) == 1:
        raise failed[0][1]
    if failed:
        raise JobsFailed("; ".join(f"{i}: {error}" for i, error in failed)) from failed[0][1]
    return [f.result() for f in futures]
