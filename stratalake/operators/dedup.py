"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row, except maps and variants."""
    fields = df.schema.fields
    if all(_hashable(f.dataType) for f in fields):
        return F.xxhash64("*")
    return F.xxhash64(*[f"`{f.name}`" for f in fields if _hashable(f.dataType)])


def latest_per_key(
    df: DataFrame, key: str, version: str, tie_breakers: Sequence[str] | None = None
) -> DataFrame:
    """Keep the row with the highest ``version`` of every ``key``; NULL versions
    come last.

    Rows of equal version are ordered by ``tie_breakers``, or by a hash of the
    row, so the result does not depend on file or task order. The hash is taken
    before the shuffle: columns that nobody reads later, such as a long JSON
    document, are not moved for the sake of the order.

    Keeping one row of a row_number lets Spark discard the losers of each input
    partition before the shuffle (WindowGroupLimit): a key that holds a third of
    the table arrives at its reducer as one row per map task.
    """
    newest_first = [F.col(version).desc_nulls_last()]
    if tie_breakers is None:
        df = df.withColumn("_tie", row_hash(df))
        newest_first.append(F.col("_tie").desc())
    else:
        newest_first += [F.col(c).desc_nulls_last() for c in tie_breakers]
    by_key = Window.partitionBy(key).orderBy(*newest_first)
    ranked = df.withColumn("_rank", F.row_number().over(by_key))
    return ranked.filter("_rank = 1").drop("_rank", "_tie")
