"""Spark session settings shared by the library, the tests and the bench.

On a cluster the session is created by the platform; ``configure`` only
adds the SQL settings the operators rely on (UTC, ANSI, AQE) and leaves
anything the cluster already set alone.
"""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator assumes. Timestamps are zone-less (TIMESTAMP_NTZ)
# but month keys and day counts must not depend on the driver's zone.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What a shuffle task is given: sorted and hashed, rows take thirty times the bytes they have in a shuffle.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Fact rows for each partition that a shuffle starts with.
ROWS_A_PARTITION = 500_000
#: How many partitions AQE starts with, and what ``fit_shuffles`` last set there.
_PARTITIONS, _FITTED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "rentscope.fittedPartitions"


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SQL_DEFAULTS`` where the session has no explicit value."""
    for key, value in SQL_DEFAULTS.items():
        if key == "spark.sql.session.timeZone":
            spark.conf.set(key, value)  # results are defined in UTC
        elif spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles start from a partition for every ROWS_A_PARTITION of ``rows``.

    A task's share of a join then doesn't grow with the tables; AQE merges what
    turns out small. ``spark.sql.shuffle.partitions`` is the least, and stays as
    it is; a number of first partitions that the session has of its own holds.
    """
    held = spark.conf.get(_PARTITIONS, None)
    if held is not None and held != spark.conf.get(_FITTED, None):
        return
    wanted = max(math.ceil(rows / ROWS_A_PARTITION), int(held or 0))  # tables loaded before may still be in use
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_PARTITIONS, str(wanted))
        spark.conf.set(_FITTED, str(wanted))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as is. Only a local-mode session (tests, the bench) without that
    setting gets a fresh scratch folder; on a cluster a missing setting is
    an error, since a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store)")
        configured = tempfile.mkdtemp(prefix="rentscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "rentscope") -> SparkSession:
    """Session for tests and the bench: local mode, no UI, small shuffles."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("RENTSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
