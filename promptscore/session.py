"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on; all can be set on a live session.

    Functions of this package are sent to Python workers by value, so the package need not be
    installed on the executors.
    """
    cloudpickle.register_pickle_by_value(sys.modules["promptscore"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only a local session without one gets a temporary folder, because there the driver and the
    executors are the same machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="promptscore-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A path of its own for one run, so that no run reads or overwrites another's tables."""
    return f"{shared_root(spark)}/promptscore/{label}-{uuid.uuid4().hex}"
