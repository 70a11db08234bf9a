"""Jobs for spark-submit: ingest-tables, ingest-apis, build, check, promote."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from stratalake import contracts
from stratalake.params import BuildParams
from stratalake.plans import pipeline
from stratalake.scratch import clear
from stratalake.sinks.landing import table_path
from stratalake.sinks.tables import Lake
from stratalake.sources.config import load_entries
from stratalake.sources.ingest import (
    ENDPOINT_KEYS,
    MYSQL_TABLE_KEYS,
    TABLE_KEYS,
    Loaded,
    ingest_apis,
    ingest_tables,
)
from stratalake.sources.jdbc import DIALECTS
from stratalake.sources.landing import scan


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",") if w.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalake", description=__doc__)
    top.add_argument("--environment", default="dev", help="label in the application name")
    jobs = top.add_subparsers(dest="job", required=True)

    tables = jobs.add_parser("ingest-tables", help="copy database tables to landing")
    tables.add_argument("--dialect", choices=sorted(DIALECTS), required=True)
    tables.add_argument("--config", required=True, help="JSON file of table entries")
    tables.add_argument("--landing", required=True)
    tables.add_argument("--conn-id", help="connection of entries that name none")
    tables.add_argument("--prefix", help="folder instead of the schema name")
    tables.add_argument("--promote-integers", action="store_true")

    apis = jobs.add_parser("ingest-apis", help="copy API responses to landing")
    apis.add_argument("--config", required=True, help="JSON file of endpoint entries")
    apis.add_argument("--landing", required=True)

    for name in ("build", "check"):
        job = jobs.add_parser(name, help=f"{name} the layer tables")
        job.add_argument("--landing", required=True)
        job.add_argument("--schema", required=True, help="source schema of the landed tables")
        job.add_argument("--layers", type=_words, help="comma-separated; default all")
        job.add_argument("--domains", type=_words, help="comma-separated; default all")
        if name == "build":
            job.add_argument("--lake", required=True, help="root folder of the layer tables")
            job.add_argument("--format", default="parquet", help="parquet, iceberg or delta")
            job.add_argument("--buckets", type=int, help="bucket bronze tables by their key")
            job.add_argument("--folders", type=int, help="bronze tables in folders by their key")
            job.add_argument("--full-refresh", action="store_true")
            job.add_argument("--check-first", action="store_true", help="publish only clean tables")
            job.add_argument("--as-of", type=dt.date.fromisoformat)
            job.add_argument("--dim-date-start", default=contracts.DIM_DATE_START)
            job.add_argument("--dim-date-end", default=contracts.DIM_DATE_END)
            job.add_argument("--inclusive", action="store_true", help="reload rows at the watermark")
            job.add_argument("--restart-keys", action="store_true", help="number from 1 each time")
            job.add_argument("--lenient", action="store_true", help="text that is no number is NULL")
            job.add_argument("--read-meta", action="store_true", help="fill the meta columns")
            job.add_argument("--no-keys", action="store_true", help="leave surrogate keys NULL")
            job.add_argument(
                "--tie-breakers",
                type=_ties,
                action="append",
                default=[],
                metavar="MODEL=COLUMN,...",
                help="columns that order rows of equal version; once per model",
            )

    job = jobs.add_parser("promote", help="a landed table as a table of the lake's format")
    job.add_argument("--landing", required=True)
    job.add_argument("--schema", required=True, help="source schema of the landed table")
    job.add_argument("--table", required=True)
    job.add_argument("--target", required=True, help="layer.name")
    job.add_argument("--lake", required=True, help="root folder of the layer tables")
    job.add_argument("--format", default="parquet", help="parquet, iceberg or delta")
    return top


def _ties(text: str) -> tuple[str, tuple[str, ...]]:
    model, _, columns = text.partition("=")
    if model not in pipeline.MODELS or not _words(columns):
        raise argparse.ArgumentTypeError(f"not MODEL=COLUMN,...: {text}")
    return model, tuple(_words(columns))


class _Landed(Mapping[str, DataFrame]):
    """Landed tables, each scanned when it is asked for."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.paths = {name: table_path(root, schema, name) for name in ("plants", "licenses")}
        self.spark = spark

    def __getitem__(self, name: str) -> DataFrame:
        return scan(self.spark, self.paths[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)


def _show(loaded: Sequence[Loaded]) -> None:
    for copy in loaded:
        print(f"{copy.rows} rows in {copy.path}")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "ingest-tables":
        required = MYSQL_TABLE_KEYS if args.dialect == "mysql" else TABLE_KEYS
        setting = f"stratalake.{args.dialect}.tables"
        entries = load_entries(spark, args.config, setting, [], required)
        conn_id = args.conn_id or f"{args.dialect}_source"
        params = BuildParams(promote_integers=args.promote_integers)
        _show(
            ingest_tables(
                spark, args.dialect, entries, args.landing, conn_id, args.prefix, params
            )
        )
    elif args.job == "ingest-apis":
        entries = load_entries(spark, args.config, "stratalake.endpoints", [], ENDPOINT_KEYS)
        _show(ingest_apis(spark, entries, args.landing))
    elif args.job == "build":
        params = BuildParams(
            as_of=args.as_of,
            dim_date_start=args.dim_date_start,
            dim_date_end=args.dim_date_end,
            environment=args.environment,
            inclusive=args.inclusive,
            restart_keys=args.restart_keys,
            strict=not args.lenient,
            read_meta=args.read_meta,
            number_rows=not args.no_keys,
            tie_breakers=dict(args.tie_breakers),
        )
        pipeline.run(
            spark,
            _Landed(spark, args.landing, args.schema),
            Lake(args.lake, args.format, args.buckets, args.folders),
            params,
            args.layers,
            args.domains,
            args.full_refresh,
            args.check_first,
        ).show(truncate=False)
    elif args.job == "promote":
        landed = scan(spark, table_path(args.landing, args.schema, args.table))
        table = pipeline.promote(landed, Lake(args.lake, args.format), args.target)
        print(f"{table.count()} rows in {args.target}")
    else:
        names = pipeline.selected(args.layers, args.domains)
        report = pipeline.check(spark, _Landed(spark, args.landing, args.schema), names)
        report.show(truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"stratalake-{args.environment}").getOrCreate()
    try:
        run(spark, args)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()
