"""Working tables: where they go, and that they go away."""

import os

import pytest

from threadlens import work


class Conf:
    def __init__(self, named):
        self.named = named

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default


class Session:
    """A session of which only the settings matter."""

    def __init__(self, named, master):
        self.conf = Conf(named)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_shared_folder_is_the_cluster_s():
    assert work.shared_root(Session("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        work.shared_root(Session(None, "yarn"))
    folder = work.shared_root(Session(None, "local[2]"))
    assert os.path.isdir(folder) and work.shared_root(Session(None, "local[2]")) == folder


def test_drop(spark):
    space = work.Workspace(spark, "test")
    a, b = space.keep(spark.range(5)), space.keep(spark.range(7))
    space.drop(a, spark.range(3))
    assert b.count() == 7 and len(os.listdir(space.path.removeprefix("file:"))) == 1
