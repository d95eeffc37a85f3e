"""Shared storage for plans that cut lineage or are reused within a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, tuple[str, object]] = {}


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; with a local master, where that is unset, below a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a written table: later plans start from its files."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what stands in a folder, so that a table made from older files isn't taken for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def once(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """build() as a table that is written once for each session and state of an input folder."""
    key = (spark.sparkContext.applicationId, scope, _state(spark, scope), name)
    if key not in _KEPT:
        df = build()
        path = shared_path(spark)
        df.write.parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
