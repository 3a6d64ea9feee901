"""Tumbling, sliding and session windows, duplicate removal and a stream-static join, with watermarks.

The stream reads a folder or file of Parquet events; NTZ times become zoned ones, since
watermarks need them. ``drained`` runs a streaming plan over what is there and gives the
rows it emitted, through a memory sink locally or a Parquet sink in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.folders import new_folder


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events in a Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step))
    return rows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def with_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """A stream-static join."""
    return events.join(users, "user_id").select("event_id", "user_id", "segment")


def drained(plan: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs the stream over what is there now and returns the rows it gave out, from files in the shared folder.

    In complete mode each batch writes the whole result to a folder of its own, and the last one is read.
    """
    spark = plan.sparkSession
    folder = new_folder(spark, "stream")
    writer = plan.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}-state")
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return spark.createDataFrame([], plan.schema)
    if mode == "append":
        writer.format("parquet").start(folder).awaitTermination()
        return spark.read.schema(plan.schema).parquet(folder)
    last = []

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")  # a batch that runs again replaces itself
        last[:] = [number]

    writer.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(plan.schema).parquet(f"{folder}/batch-{last[0]}") if last else spark.createDataFrame([], plan.schema)
