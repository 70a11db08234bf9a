"""Where written intermediates go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from stratalake import scratch


def session(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: configured or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_the_named_folder_is_used():
    assert scratch.scratch_root(session("yarn", "hdfs://shared/cp/")) == "hdfs://shared/cp"
    path = scratch.scratch_path(session("yarn", "hdfs://shared/cp"), "x")
    assert path.startswith("hdfs://shared/cp/stratalake/app-yarn/x-")


def test_a_temporary_folder_only_in_local_mode():
    assert scratch.scratch_root(session("local[2]")) == scratch.scratch_root(session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(session("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(session("local-cluster[2,1,1024]"))
