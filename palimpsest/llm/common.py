"""Shared storage and reading for the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed limits of one Arrow batch, so that very long texts don't gather in a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    It is spark.checkpoint.dir where that is set; only without one, and with a local master (as in tests), a temporary
    folder is made and set as the checkpoint folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that go before their session does; the shuffles behind one go as soon as it is written."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame) -> DataFrame:
        """As written()."""
        spark = df.sparkSession
        before, path = spark.conf.get(self.CLEAN, "false"), shared_dir(spark)
        spark.conf.set(self.CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(self.CLEAN, before)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that written() returned; without any, of all."""
        for key in [id(t) for t in tables] or list(self.paths):
            df, name = self.paths.pop(key)
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """run, an Arrow function, whose worker gives its free memory back at the end of each task.

    Workers serve many stages; without this each keeps the most that any of them took.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Gives unused memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(df: DataFrame, factor: int = 2) -> int:
    """How many buckets to deal work over: at least factor per shuffle partition, and one per 32 MB of estimated input."""
    spark = df.sparkSession
    least = factor * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a plan without figures
        size = 0
    return max(least, min(size >> 25, 1_000_000))
