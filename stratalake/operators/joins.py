"""Joins of a large fact-like side to a dimension."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 0.01
TRACKED_PER_KEY = 40


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[Any]:
    """Keys with about ``share`` of all rows or more; at most 1 / ``share`` of them.

    Each task keeps a sketch of its most frequent keys and the sketches are merged, so no key
    moves a row. A key is listed if its estimated count is that share, NULL never.
    """
    most = int(1 / share)
    top = F.expr(f"approx_top_k(`{key}`, {most}, {most * TRACKED_PER_KEY})")
    found = df.agg(F.count("*").alias("n"), top.alias("top")).first()
    return [t["item"] for t in found.top or [] if t["item"] is not None and t["count"] >= share * found.n]


def left_join_spread(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: Sequence[Any] = ()
) -> DataFrame:
    """Left equi-join on ``key`` whose NULL-key rows are spread over reducers.

    A plain shuffle sends all NULL keys to one task. Here NULL keys get the hash of
    ``spread_by`` as a second key part, which spreads them over all reducers, however
    many; they match nothing. Rows of the keys in ``hot`` (``hot_keys``) get one of as many
    parts as there are reducers, and the right rows of these keys, a bounded number, are there
    once for each part. All other rows have 0 on both sides, so the matches are
    those of the plain join. A hot key that is not listed is left to
    adaptive skew-join handling, which splits the left rows of that key above its threshold.
    """
    zero = F.lit(0).cast("long")
    left_part = F.when(F.col(key).isNull(), F.xxhash64(spread_by))
    right_parts = F.array(zero)
    if hot:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        is_hot = F.col(key).isin(list(hot))
        left_part = left_part.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(parts)))
        every = F.sequence(zero, F.lit(parts - 1).cast("long"))
        right_parts = F.when(is_hot, every).otherwise(right_parts)
    keyed = right.filter(F.col(key).isNotNull()).withColumn(
        "_spread", F.explode(right_parts) if hot else zero
    )
    return (
        left.withColumn("_spread", left_part.otherwise(zero))
        .join(keyed, [key, "_spread"], "left")
        .drop("_spread")
    )
