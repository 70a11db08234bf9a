"""Bronze models: the latest row of every source key, cast and labelled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.contracts import LICENSE_COLUMNS, LICENSE_META, PLANT_COLUMNS, PLANT_META
from stratalake.functions.casts import (
    blank_to_number,
    empty_to_number,
    to_timestamp,
    typed_nulls,
)
from stratalake.functions.labels import provider_label, state_label
from stratalake.functions.payload import extract_fields
from stratalake.functions.status import license_cycle, license_status
from stratalake.operators.dedup import latest_per_key
from stratalake.operators.incremental import newer_than_mark, watermark
from stratalake.operators.numbering import attach_keys, rank_ids
from stratalake.params import BuildParams
from stratalake.scratch import written


def _known_keys(
    ids: DataFrame, target: DataFrame, key_col: str, target_id: str, highest: int
) -> DataFrame:
    """Keys of an increment: ids the target knows keep theirs, the others continue
    after its highest key.

    Only ids and keys move, never whole rows. The ids are written first, so their
    size is known: a small increment is broadcast to the target's two columns,
    which are then filtered in place.
    """
    ids = written(ids, f"ids-{key_col}")
    stored = target.select(F.col(target_id).alias("id"), key_col)
    known = written(stored.join(ids, "id", "left_semi"), f"known-{key_col}")
    fresh = ids.join(known, "id", "left_anti")
    return known.unionByName(rank_ids(fresh, "id", key_col, after=F.lit(highest)))


def _latest_numbered(
    landed: DataFrame,
    params: BuildParams,
    target: DataFrame | None,
    columns: Sequence[str],
    key_col: str,
    target_id: str,
    tie_breakers: Sequence[str] | None,
    all_rows: bool,
) -> DataFrame:
    """Landing rows to read in this run, one per id, with the surrogate key. With a
    target these are the rows past its watermark, or ``all_rows``.

    Columns that the model does not use are dropped before the dedup: they are
    neither scanned nor hashed, and rows that differ only there are the same row
    to the model.
    """
    feed = landed.withColumn("updated_at", to_timestamp(landed, "updated_at"))
    highest = 0
    if target is not None:
        # One pass over two columns of the target, for the watermark and the keys.
        stored = watermark(target, "UPDATED_AT", F.coalesce(F.max(key_col), F.lit(0)).alias("key"))
        mark, highest = stored.first()
        if not all_rows:
            feed = newer_than_mark(feed, "updated_at", mark, params.inclusive)
    more = [c for c in tie_breakers or () if c not in columns]
    latest = latest_per_key(feed.select(*columns, *more), "id", "updated_at", tie_breakers)
    if not params.number_rows:
        return latest.withColumn(key_col, F.lit(None).cast("long"))
    # The ids come from the feed, not from the deduplicated rows: a one-column
    # scan instead of a second pass over whole rows.
    ids = feed.select("id").distinct()
    if target is None or params.restart_keys:
        keys = rank_ids(ids, "id", key_col)
    else:
        keys = _known_keys(ids, target, key_col, target_id, highest)
    return attach_keys(latest, keys, "id", key_col)


def _column(df: DataFrame, out: str, source: str, rule: str, params: BuildParams) -> Column:
    match rule:
        case "keep":
            return F.expr(f"`{source}` AS `{out}`")
        case "timestamp":
            value = to_timestamp(df, source)
        case "date":
            value = F.col(source).cast("date")
        case "long_blank":
            value = blank_to_number(df, source, "bigint", params.strict)
        case "int_blank":
            value = blank_to_number(df, source, "int", params.strict)
        case "long_empty":
            value = empty_to_number(df, source, "bigint", params.strict)
        case "state":
            value = state_label(F.col(source))
        case "provider":
            value = provider_label(F.col(source))
        case "cycle":
            value = license_cycle(params.today())
        case "status":
            value = license_status(params.today())
        case _:
            raise ValueError(f"unknown column rule {rule!r}")
    return value.alias(out)


def _stage(
    model: str,
    landed: DataFrame,
    params: BuildParams,
    target: DataFrame | None,
    key_col: str,
    columns: Mapping[str, tuple[str, str]],
    meta: Mapping[str, str],
    all_rows: bool,
) -> DataFrame:
    """Key, named columns, meta columns and load stamp, in contract order."""
    needed = list(dict.fromkeys(source for source, _ in columns.values()))
    if params.read_meta:
        needed.append("meta")
    ident = next(iter(columns))
    ties = params.tie_breakers.get(model)
    rows = _latest_numbered(landed, params, target, needed, key_col, ident, ties, all_rows)
    if params.read_meta:
        rows = rows.withColumn("_meta", extract_fields(F.col("meta"), meta))
        from_meta = [F.col(f"_meta.{name}").alias(name) for name in meta]
    else:
        from_meta = typed_nulls(meta)
    return rows.select(
        key_col,
        *[_column(rows, out, *rule, params) for out, rule in columns.items()],
        *from_meta,
        params.today().alias("LOAD_DATE"),
    )


def stg_plants(
    landed: DataFrame,
    params: BuildParams = BuildParams(),
    target: DataFrame | None = None,
    all_rows: bool = False,
) -> DataFrame:
    """Plants, one row per id. With ``target``, only rows past its watermark, unless
    ``all_rows``; ids that it knows keep their keys."""
    return _stage(
        "stg_plants", landed, params, target, "PLANT_KEY", PLANT_COLUMNS, PLANT_META, all_rows
    )


def stg_licenses(
    landed: DataFrame,
    params: BuildParams = BuildParams(),
    target: DataFrame | None = None,
    all_rows: bool = False,
) -> DataFrame:
    """Licenses, one row per id. With ``target``, only rows past its watermark, unless
    ``all_rows``; ids that it knows keep their keys."""
    return _stage(
        "stg_licenses", landed, params, target, "LICENSE_KEY", LICENSE_COLUMNS, LICENSE_META,
        all_rows,
    )
