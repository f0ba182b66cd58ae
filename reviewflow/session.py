"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators rely on. All are ordinary Spark SQL settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Texts are long: a batch for a Python worker ends at this size, however few rows it has.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
# For streams whose state outgrows memory: state beside the heap, saved as changes. Small state is
# faster with Spark's own default.
LARGE_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Bytes of a shuffle partition to aim for.
PARTITION_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession, large_state: bool = False,
              shuffled_bytes: int | None = None) -> SparkSession:
    """Set what the operators rely on.

    ``shuffled_bytes``, the size of the largest shuffle expected, sets the number of shuffle
    partitions; adaptive execution joins small ones again.
    """
    settings = {**SETTINGS, **(LARGE_STATE if large_state else {})}
    if shuffled_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(max(
            spark.sparkContext.defaultParallelism, -(-shuffled_bytes // PARTITION_BYTES)))
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of written tables, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def make_dir(spark: SparkSession, path: str) -> None:
    """Make a folder, so that reading it gives no rows where none were written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir``, the folder every executor can reach. Only where
    that is unset and Spark is a single local process does it fall back to the machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="reviewflow-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
