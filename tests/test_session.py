"""Where intermediate data may go."""

from types import SimpleNamespace

import pytest

from lakewarden.session import scratch_dir


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=context)


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session(master), "x")


def test_the_shared_folder_is_used_where_named():
    assert scratch_dir(session("yarn", "hdfs://h/shared"), "x").startswith("hdfs://h/shared/x-")


def test_one_machine_needs_none():
    assert scratch_dir(session("local[2]"), "x")
