"""The shared folder, partition counts and checkpoints of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import textbytes as tb


#: Bytes of an Arrow batch between the engine and Python, about. Both sides hold a batch whole, in each running task.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to BATCH_BYTES; a lower one, or one given in other units, stays."""
    size = spark.conf.get(BATCH_SETTING).rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    bound_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have:
        return have
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: work done once, with no lineage before it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a table from written(); nothing may read it any more."""
    remove(df.sparkSession, df.written_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Hadoop's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(shared: Broadcast) -> None:
    """In a task: drops the loaded value of a broadcast, which a worker would keep for later tasks; the next use loads it again."""
    vars(shared).pop("_value", None)


def keep_rows(docs: DataFrame, prepare: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], shared: Broadcast | None = None) -> DataFrame:
    """The rows of docs, with all columns, for which the function that ``prepare`` makes in a task says so.

    It gets the UTF-8 bytes and offsets of a run of texts (nulls are empty). A text goes to Python once, as its column.
    ``shared`` is what the function reads; a worker keeps it no longer than the task.
    """
    place = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = prepare()
        for batch in batches:
            flags = [judge(data, offsets) for _, _, data, offsets in tb.slices(batch.column(place), 1 << 20)]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))
        del judge
        if shared is not None:
            forget(shared)
        tb.trim()

    return docs.mapInArrow(run, docs.schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
