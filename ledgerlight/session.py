"""Session helpers: local sessions for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlight", extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster one (AQE, skew handling,
    UTC), with the UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", os.environ.get("LEDGERLIGHT_DRIVER_MEMORY", "8g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    log_dir = os.environ.get("LEDGERLIGHT_EVENT_LOG_DIR")
    if log_dir:
        # Stage and task times for offline analysis (no UI, no server).
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Settings for a large cluster (100 TB class inputs); the cluster's own
# configuration normally carries them.  Partition counts are left to AQE:
# a high initial shuffle partition count is coalesced at run time to the
# advisory size, and skewed partitions are split.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Key sets of a window, too large to broadcast, become bloom filters.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "512m",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "50000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "400000000",
}


def apply_cluster_settings(spark: SparkSession) -> None:
    """Set the runtime-modifiable settings above that the cluster left unset."""
    for key, value in CLUSTER_SETTINGS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared work folder (``spark.checkpoint.dir``).

    On a cluster this setting names shared storage every executor can reach;
    it is read from the session.  Without it a cluster run stops here, as its
    executors would write to disks that nobody else sees; a local session
    (tests) gets a private folder, registered as the checkpoint dir."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="ledgerlight-ckpt-")
    sc.setCheckpointDir(path)
    return (sc.getCheckpointDir() or path).rstrip("/")
