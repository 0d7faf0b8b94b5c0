"""SparkSession construction with settings that matter at scale."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Applied to a session only where neither the deployment nor the caller has set a value.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins pick broadcast only below this measured size; above it they
    # fall back to sort-merge.  AQE re-checks with runtime sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flightmart", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, so its heap is the
        # memory of the whole job (a cluster sizes executors instead)
        builder = builder.config("spark.driver.memory", os.environ.get("FLIGHTMART_DRIVER_MEMORY", _half_of_memory()))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    known = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if not known.contains(k) and k not in (extra or {}):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _half_of_memory() -> str:
    mb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (2 << 20)
    return f"{min(16 * 1024, mb)}m"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to a shared (distributed) folder and
    it is used as is; if it is unset there, this raises.  Only in local mode
    (tests) is a scratch folder of our own picked when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            # executors cannot share a folder on the driver's disk
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared (distributed) folder")
        current = tempfile.mkdtemp(prefix="flightmart-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(current)
    return current


def cluster_settings(shuffle_bytes: int, total_cores: int,
                     target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run, from the expected shuffle volume.

    Each shuffle partition should hold about ``target_partition_bytes`` so
    a task's sort / hash buffers fit in executor memory without heavy
    spilling; AQE starts from this many partitions and coalesces small
    ones.  At least three partitions per core keep every core busy.
    Example: 100 TB of shuffle on 1000 executors x 8 cores gives about
    400k initial partitions.
    """
    n = max(3 * total_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
