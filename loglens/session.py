"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "loglens") -> SparkSession:
    """Session for tests and the benchmark; on a cluster use the provided session."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for state tables and stream checkpoints: the session's
    ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, may leave it unset;
    it gets one temporary folder.  A cluster must name a folder that the
    driver and all executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="loglens-ckpt-")
    return _OWN[context.applicationId]


def new_state_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    return path
