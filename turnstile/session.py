"""Session settings and the shared folder for written intermediate data."""

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution works from measured sizes: it merges small partitions up
# to the advisory size, splits skewed join partitions, broadcasts a join side
# that proved small, and hashes instead of sorting where every partition of
# the smaller side fits the limit below.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # State of streams stands on disk instead of the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    for key, value in {**CLUSTER_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session may do without that setting; on a cluster a folder of
    one machine would lose data with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="turnstile-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
