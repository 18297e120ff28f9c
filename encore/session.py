"""Spark session settings shared by the library, the tests and the bench.

The library itself never creates a session: every operator takes and returns
DataFrames. These helpers only pin the settings the operators rely on
(UTC session time zone, ANSI mode, AQE) and resolve the shared checkpoint
folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every session running encore operators should carry.
REQUIRED_CONF = {
    # timestamps in play logs are UTC text and are never shifted
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # switch sort-merge joins to broadcast when the runtime size is small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # parquet timestamps without zone stay timestamp_ntz
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "encore",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the required settings.

    On a cluster leave ``master`` unset so spark-submit decides. The web UI is
    kept off: nothing here opens a port beyond Spark's own RPC.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine (``local[...]`` masters)."""
    return spark.conf.get("spark.master", "").startswith("local[") or spark.conf.get("spark.master", "") == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read; when
    it is unset there, this raises, because a machine-local folder would be
    seen by one executor only. On a local master (tests) a fresh scratch
    folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="encore-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written intermediate table (never shared by two calls)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a written table go when the write ends, not when the driver collects its garbage.

    For intermediate tables, which are read back from where they were written. A Spark that does not know the setting
    (before 4.1) ignores it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
