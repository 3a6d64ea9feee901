"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local session that has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured and context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    if not configured and context.getCheckpointDir() is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return (configured or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own for each call."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
