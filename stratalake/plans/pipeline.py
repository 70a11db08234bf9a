"""The layered build: landing -> bronze -> silver -> gold, then the checks."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from stratalake.operators.joins import hot_keys
from stratalake.operators.quality import (
    NOT_NULL,
    UNIQUE,
    Check,
    clean_report,
    report,
    require_clean,
)
from stratalake.parallel import run_all
from stratalake.params import BuildParams
from stratalake.plans import bronze, gold, silver
from stratalake.scratch import written
from stratalake.sinks.folders import layer_rows
from stratalake.sinks.tables import Lake, merge_table, replace_table

# Model -> (layer, business domains), in build order.
MODELS = {
    "stg_plants": ("bronze", ("plants",)),
    "stg_licenses": ("bronze", ("licenses",)),
    "dw_dim_plant_profile": ("silver", ("plants", "licenses")),
    "dw_dim_date": ("silver", ("shared",)),
    "dm_plant": ("gold", ("plants", "licenses")),
}

# The data-quality suite.
CHECKS = (
    Check("plants", "id", NOT_NULL),
    Check("plants", "updated_at", NOT_NULL),
    Check("licenses", "id", NOT_NULL),
    Check("licenses", "updated_at", NOT_NULL),
    Check("stg_plants", "PLANT_ID", UNIQUE),
    Check("stg_plants", "PLANT_ID", NOT_NULL),
    Check("stg_licenses", "LICENSE_ID", UNIQUE),
    Check("stg_licenses", "LICENSE_ID", NOT_NULL),
    Check("dw_dim_plant_profile", "PLANT_ID", UNIQUE),
    Check("dw_dim_plant_profile", "PLANT_ID", NOT_NULL),
    Check("dw_dim_date", "date_key", UNIQUE),
    Check("dw_dim_date", "date_key", NOT_NULL),
    Check("dw_dim_date", "date_date", UNIQUE),
    Check("dw_dim_date", "date_date", NOT_NULL),
    Check("dm_plant", "total_plant", NOT_NULL),
)


def selected(
    layers: Collection[str] | None = None, domains: Collection[str] | None = None
) -> list[str]:
    """Models of the given layers and domains (None = all), in build order."""
    return [
        name
        for name, (layer, mine) in MODELS.items()
        if (layers is None or layer in layers)
        and (domains is None or not set(domains).isdisjoint(mine))
    ]


def table_name(model: str) -> str:
    return f"{MODELS[model][0]}.{model}"


def build(
    spark: SparkSession,
    landed: Mapping[str, DataFrame],
    lake: Lake,
    params: BuildParams = BuildParams(),
    layers: Collection[str] | None = None,
    domains: Collection[str] | None = None,
    full_refresh: bool = False,
    check_first: bool = False,
) -> list[str]:
    """Build the selected models from landed ``plants`` and ``licenses`` and the
    stored tables of models that are not selected. Returns the built names.

    With ``check_first`` the checks of a Parquet table are part of its write: a table that
    fails is not published, and no model of a later layer is built from it.
    """

    def checks_of(model: str) -> list[Check]:
        return [c for c in CHECKS if c.table == model] if check_first else []

    def stored(model: str) -> DataFrame:
        return layer_rows(spark, table_name(model))

    def merge(model: str, source: str, key: str) -> None:
        name = table_name(model)
        first_run = full_refresh or not spark.catalog.tableExists(name)
        stage = getattr(bronze, model)
        if first_run:
            replace_table(stage(landed[source], params), lake, name, key, checks_of(model))
        else:
            rows = stage(landed[source], params, target=layer_rows(spark, name))
            merge_table(rows, lake, name, key, checks_of(model))

    def make(model: str) -> None:
        name = table_name(model)
        match model:
            case "stg_plants":
                merge(model, "plants", "PLANT_ID")
            case "stg_licenses":
                merge(model, "licenses", "LICENSE_ID")
            case "dw_dim_plant_profile":
                licenses = stored("stg_licenses")
                # A repeated license would multiply plants in the join.
                unique = Check("stg_licenses", "LICENSE_ID", UNIQUE)
                require_clean(report({"stg_licenses": licenses}, [unique]))
                plants = stored("stg_plants")
                hot = hot_keys(plants, "LICENSE_ID")
                profile = silver.dim_plant_profile(plants, licenses, hot)
                replace_table(profile, lake, name, checks=checks_of(model))
            case "dw_dim_date":
                bounds = silver.configured_bounds(spark, params)
                replace_table(silver.dim_date(bounds), lake, name, checks=checks_of(model))
            case "dm_plant":
                mart = gold.dm_plant(stored("dw_dim_plant_profile"))
                replace_table(mart, lake, name, checks=checks_of(model))

    names = selected(layers, domains)
    # Models of one layer do not read each other.
    for layer in dict.fromkeys(layer for layer, _ in MODELS.values()):
        run_all(spark, make, [n for n in names if MODELS[n][0] == layer])
    return names


def check(
    spark: SparkSession,
    landed: Mapping[str, DataFrame],
    models: Collection[str] | None = None,
    built: bool = True,
) -> DataFrame:
    """Report of the suite over the stored models, unless ``built`` is false, and the landed
    tables of their domains."""
    names = list(MODELS) if models is None else list(models)
    tables = {name: landed[name] for name in _landed_of(landed, names)}
    if built:
        tables |= {m: layer_rows(spark, table_name(m)) for m in names}
    checks = [c for c in CHECKS if c.table in tables]
    return report(tables, checks) if checks else clean_report(spark, [])


def _landed_of(landed: Mapping[str, DataFrame], models: Collection[str]) -> list[str]:
    """Landed tables of the models' domains."""
    domains = {d for m in models for d in MODELS[m][1]}
    return [name for name in landed if name in domains]


def promote(landed: DataFrame, lake: Lake, table: str) -> DataFrame:
    """Landed snapshot as a table (layer.name) of the lake's format."""
    return replace_table(landed, lake, table)


def run(
    spark: SparkSession,
    landed: Mapping[str, DataFrame],
    lake: Lake,
    params: BuildParams = BuildParams(),
    layers: Collection[str] | None = None,
    domains: Collection[str] | None = None,
    full_refresh: bool = False,
    check_first: bool = False,
) -> DataFrame:
    """Build, then check; failing checks raise. Returns the report.

    With ``check_first`` the landed tables are checked before the build and the built ones
    while they are written, so that nothing faulty is published and no table is read again
    for its NULLs; the report then has the checks that were made, all of them clean.
    """
    if check_first and lake.table_format == "parquet":
        before = check(spark, landed, selected(layers, domains), built=False)
        require_clean(before)
        names = build(spark, landed, lake, params, layers, domains, full_refresh, True)
        return clean_report(spark, [c for c in CHECKS if c.table in {*names, *_landed_of(landed, names)}])
    names = build(spark, landed, lake, params, layers, domains, full_refresh)
    result = written(check(spark, landed, names), "report")
    require_clean(result)
    return result
