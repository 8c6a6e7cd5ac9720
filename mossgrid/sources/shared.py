"""Folders that the driver and all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir``. Where that is unset on one machine (tests), a
    temporary folder becomes the session's checkpoint folder; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="mossgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mossgrid-{name}-{uuid.uuid4().hex}"
