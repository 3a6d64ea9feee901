"""Readers for the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the directory, read through Spark so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a zoned timestamp: watermarks reject TIMESTAMP_NTZ."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
