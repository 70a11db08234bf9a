"""The spark-submit jobs, on landed files."""

from __future__ import annotations

import json
import os

import pytest
from test_models import T0, licenses, plants

from stratalake import scratch
from stratalake.__main__ import main, parser
from stratalake.scratch import scratch_root
from stratalake.sinks.landing import table_path, write_snapshot


@pytest.fixture
def landing(spark, tmp_path):
    root = str(tmp_path / "landing")
    write_snapshot(plants(spark, {"id": 1, "updated_at": T0}), table_path(root, "erp", "plants"))
    write_snapshot(
        licenses(spark, {"id": 1, "updated_at": T0}), table_path(root, "erp", "licenses")
    )
    yield root
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"DROP DATABASE IF EXISTS {layer} CASCADE")


def test_build_then_check(spark, landing, tmp_path, capsys):
    where = ["--landing", landing, "--schema", "erp"]
    lake = ["--lake", str(tmp_path / "lake"), "--buckets", "2"]
    dates = ["--as-of", "2024-06-30", "--dim-date-start", "2024-01-01"]
    main(["--environment", "test", "build", *where, *lake, *dates])
    assert capsys.readouterr().out.count("|unique") == 5
    assert str(spark.table("gold.dm_plant").first().total_plant) == "1"
    assert str(spark.table("bronze.stg_plants").first().LOAD_DATE) == "2024-06-30"
    folder = f"{scratch_root(spark)}/stratalake/{spark.sparkContext.applicationId}"
    assert not os.path.exists(folder)
    main(["check", *where, "--layers", "gold"])
    assert "dm_plant" in capsys.readouterr().out


def test_ingest_jobs_validate_their_config(spark, tmp_path):
    path = tmp_path / "entries.json"
    path.write_text(json.dumps([{"url": "u"}]), encoding="utf-8")
    with pytest.raises(ValueError, match=r"item 0: missing \['key'\]"):
        main(["ingest-apis", "--config", str(path), "--landing", str(tmp_path)])
    with pytest.raises(ValueError, match=r"missing \['mysql_schema', 'mysql_table'\]"):
        main(["ingest-tables", "--dialect", "mysql", "--config", str(path), "--landing", "l"])


def test_ingest_needs_a_connection(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps([{"schema": "s", "table": "t"}]), encoding="utf-8")
    with pytest.raises(ValueError, match="stratalake.connection.oracle_source.host"):
        main(["ingest-tables", "--dialect", "oracle", "--config", str(path), "--landing", "l"])


def test_the_calendar_needs_no_landing(spark, tmp_path):
    where = ["--landing", str(tmp_path / "nothing"), "--schema", "erp"]
    try:
        main(["build", *where, "--lake", str(tmp_path / "lake"), "--domains", "shared"])
        assert spark.table("silver.dw_dim_date").count() == 7670
        main(["check", *where, "--domains", "shared"])
    finally:
        spark.sql("DROP DATABASE IF EXISTS silver CASCADE")


def test_build_parameters(spark, landing, tmp_path):
    where = ["--landing", landing, "--schema", "erp", "--lake", str(tmp_path / "lake")]
    more = ["--inclusive", "--restart-keys", "--lenient", "--read-meta", "--no-keys"]
    ties = ["--tie-breakers", "stg_plants=number,meta", "--tie-breakers", "stg_licenses=user_id"]
    args = parser().parse_args(["build", *where, *more, *ties])
    assert dict(args.tie_breakers) == {
        "stg_plants": ("number", "meta"), "stg_licenses": ("user_id",)
    }
    main(["build", *where, *more, *ties])
    assert spark.table("bronze.stg_plants").first().PLANT_KEY is None
    with pytest.raises(SystemExit):
        parser().parse_args(["build", *where, "--tie-breakers", "unheard=a"])


def test_promote(spark, landing, tmp_path, capsys):
    where = ["--landing", landing, "--schema", "erp", "--lake", str(tmp_path / "lake")]
    main(["promote", *where, "--table", "plants", "--target", "bronze.landed_plants"])
    assert "1 rows in bronze.landed_plants" in capsys.readouterr().out
    assert spark.table("bronze.landed_plants").count() == 1


def test_clean_up_never_hides_an_error(spark, monkeypatch):
    """Nothing was written: no folder is asked for, so none has to be named."""
    monkeypatch.setattr(scratch, "_used", {})
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: 1 / 0)
    scratch.clear(spark)
    monkeypatch.setattr(scratch, "_used", {spark.sparkContext.applicationId: "no-such-scheme://x"})
    scratch.clear(spark)
