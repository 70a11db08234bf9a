"""Dense surrogate keys without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.scratch import written

# monotonically_increasing_id puts the row number of a partition in the low 33 bits.
_ROW_BITS = (1 << 33) - 1


def rank_ids(ids: DataFrame, id_col: str, key_col: str, after: Column | int = 0) -> DataFrame:
    """(id, key) with key = ``after`` + position of the id in ascending order,
    NULL last. ``ids`` holds one column without duplicates.

    Only the id column is range-partitioned and sorted; each partition numbers
    its own rows and adds the row count of the partitions before it. The
    placement is written out once, because counts and positions must come from
    the same range bounds, also after an executor is lost.
    """
    order = F.col(id_col).asc_nulls_last()
    placed = written(
        ids.select(id_col)
        .repartitionByRange(order)
        .sortWithinPartitions(order)
        .select(
            id_col,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
        ),
        f"rank-{key_col}",
    )
    # One row per range partition, so one task and a broadcast are enough.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.orderBy("_part"))
    offsets = sizes.select("_part", (running - F.col("_n")).alias("_before"))
    after = F.lit(after) if isinstance(after, int) else after
    return placed.join(F.broadcast(offsets), "_part").select(
        id_col, (after + F.col("_before") + F.col("_row") + 1).cast("long").alias(key_col)
    )


def attach_keys(df: DataFrame, keys: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """Add the key of each row's id. The join is on the bare id, so a ``df`` that
    is already partitioned by id is not shuffled again. A NULL id, which sorts
    last, takes its key from a one-row subquery because NULL does not join."""
    of_null = keys.filter(F.col(id_col).isNull()).agg(F.max(key_col)).scalar()
    return df.join(keys.filter(F.col(id_col).isNotNull()), id_col, "left").withColumn(
        key_col, F.coalesce(F.col(key_col), F.when(F.col(id_col).isNull(), of_null))
    )


def add_surrogate_key(df: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """Number the rows of ``df`` 1..n in id order; ``id_col`` must be unique."""
    return attach_keys(df, rank_ids(df.select(id_col), id_col, key_col), id_col, key_col)
