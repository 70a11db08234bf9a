"""Bronze loads that follow the landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalake.params import BuildParams
from stratalake.scratch import written
from stratalake.sinks.folders import layer_rows
from stratalake.sinks.tables import Lake, merge_table


def follow_landing(
    spark: SparkSession,
    landing_path: str,
    schema: str,
    model: Callable[..., DataFrame],
    lake: Lake,
    table: str,
    key: str,
    checkpoint: str,
    params: BuildParams = BuildParams(),
) -> StreamingQuery:
    """Load the landed files that no earlier run has seen, then stop.

    The checkpoint remembers the files, so a micro-batch takes all its rows: files may
    come in any order, and the table's watermark says nothing about them. A stored row is
    replaced by a version that is not older. Where a batch brings another row of the very
    version that is stored, the row that a load of all landed files would choose is taken,
    read from those files. A batch that is run again after a failure changes nothing.
    """

    def load(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        if not session.catalog.tableExists(table):
            merge_table(model(batch, params), lake, table, key)
            return
        stored = layer_rows(session, table)
        rows = written(model(batch, params, target=stored, all_rows=True), f"batch-{table}")
        landed = session.read.schema(schema).parquet(landing_path)
        merge_table(_not_older(rows, stored, landed, model, params, key), lake, table, key)

    return (
        spark.readStream.schema(schema)
        .parquet(landing_path)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _not_older(
    rows: DataFrame,
    stored: DataFrame,
    landed: DataFrame,
    model: Callable[..., DataFrame],
    params: BuildParams,
    key: str,
) -> DataFrame:
    """Rows of a batch that may replace the stored ones."""
    content = [c for c in stored.columns if c != "LOAD_DATE"]
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    # No key matches a NULL, so such rows are new each time, as in any merge.
    compared = rows.alias("n").join(stored.alias("s"), F.expr(f"n.`{key}` = s.`{key}`"), "left")
    new, old = F.col("n.UPDATED_AT"), F.col("s.UPDATED_AT")
    known = F.col(f"s.`{key}`").isNotNull()
    tied = known & new.eqNullSafe(old) & ~same
    later = ~known | F.coalesce(new > old, new.isNotNull() & old.isNull(), F.lit(False))
    fresh = compared.filter(later).select("n.*")
    ids = written(compared.filter(tied).select(F.expr(f"n.`{key}` AS id")), "tied")
    if ids.isEmpty():
        return fresh
    chosen = model(landed.join(ids, "id", "left_semi"), params, target=stored, all_rows=True)
    return fresh.unionByName(chosen)
