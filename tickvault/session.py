"""Session helpers: local test session and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every session of ours relies on: UTC session zone (bars are
# wall-clock dates, never shifted), AQE for runtime coalescing and skew splits.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # a plain scan's file size bounds it, so a small table joins without
    # shuffling the big side; derived sides are materialised and counted before
    # they are broadcast, and AQE converts what it has measured
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
}


def recommended_conf(total_input_bytes: int | None = None) -> dict[str, str]:
    """Settings for a cluster session (apply with ``SparkSession.builder.config``).

    Shuffle partitions are sized for ~256 MB each at the given input size (AQE
    coalesces small ones); files are split at 256 MB.
    """
    conf = dict(BASE_CONF)
    conf.pop("spark.ui.enabled")
    conf["spark.sql.files.maxPartitionBytes"] = str(256 << 20)
    conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(256 << 20)
    if total_input_bytes:
        conf["spark.sql.shuffle.partitions"] = str(max(200, int(total_input_bytes // (256 << 20))))
    return conf


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tickvault") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; we only set one of our own
    when it is unset in local mode (tests). Off local mode a missing setting is
    an error: executors would each write their own disk.
    """
    cp = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if cp:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(cp)
        return cp
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    cp = tempfile.mkdtemp(prefix="tickvault-cp-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", cp)
    spark.sparkContext.setCheckpointDir(cp)
    return cp


#: Spark 4.1; an older one keeps shuffle files until the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside, from frames made inside, leaves no shuffle files
    behind: they go when the write ends, so a job of many steps holds those of
    one step at a time."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return root.rstrip("/") + "/" + name
