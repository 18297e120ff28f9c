"""Scratch storage: shared on clusters, never the same path twice."""

import pytest

from encore import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    """The two members of a session that the scratch helpers use."""

    def __init__(self, **values):
        self.conf = _Conf({k.replace("_", "."): v for k, v in values.items()})
        self.sparkContext = self

    def setCheckpointDir(self, path):  # noqa: N802
        self.path = path


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            session.scratch_path(_Session(spark_master=master), "x")
    assert session.scratch_path(_Session(spark_master="local[4]"), "x")


def test_the_cluster_setting_is_used_as_it_is():
    found = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs://nn/tmp/")
    assert session.scratch_path(found, "x").startswith("hdfs://nn/tmp/x-") and found.path == "hdfs://nn/tmp/"


def test_two_calls_never_share_a_path(spark):
    paths = {session.scratch_path(spark, "x") for _ in range(50)}
    paths |= {session.scratch_path(spark.newSession(), "x") for _ in range(50)}
    assert len(paths) == 100
