"""High-watermark reads and the keyed merge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.contracts import EPOCH
from stratalake.functions.casts import to_timestamp


def watermark(target: DataFrame, column: str, *more: Column) -> DataFrame:
    """One row, ``watermark``: the highest timestamp of the target, or the epoch; and
    ``more`` aggregates of the same pass."""
    return target.agg(
        F.coalesce(
            F.max(to_timestamp(target, column)), F.lit(EPOCH).cast("timestamp_ntz")
        ).alias("watermark"),
        *more,
    )


def newer_than(
    feed: DataFrame,
    column: str,
    target: DataFrame,
    target_column: str,
    inclusive: bool = False,
) -> DataFrame:
    """``newer_than_mark`` with the watermark of the target."""
    mark = watermark(target, target_column).first().watermark
    return newer_than_mark(feed, column, mark, inclusive)


def newer_than_mark(
    feed: DataFrame, column: str, mark: dt.datetime, inclusive: bool = False
) -> DataFrame:
    """Feed rows past the target's watermark.

    The watermark, one row, is computed once and becomes a literal: however often
    the feed is read later, the target is scanned once, and the literal reaches
    the file scan of the feed. Rows equal to the maximum that arrive late are
    skipped unless ``inclusive``; reading them again is harmless because the
    merge replaces whole rows.
    """
    # As text: a Python datetime would be read in the time zone of the driver.
    limit = F.lit(mark.isoformat(" ")).cast("timestamp_ntz")
    stamp = to_timestamp(feed, column)
    return feed.filter(stamp >= limit if inclusive else stamp > limit)


def upsert(
    target: DataFrame, source: DataFrame, key: str, co_located: bool = False
) -> DataFrame:
    """Target after the merge: matched rows replaced, new rows added, others kept.
    ``source`` has unique keys; a NULL key never matches.

    Only the source's keys meet the target. While they are below the broadcast
    limit the target is not shuffled at all; beyond it Spark sort-merges.
    ``co_located`` is for a target bucketed by the key and a source partitioned
    like it: each bucket meets its own keys in one hash join, without a shuffle
    or sort of the target, and its files are rewritten as one.
    """
    keys = source.select(key)
    if co_located:
        keys = keys.hint("shuffle_hash")
    kept = target.join(keys, key, "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))
