"""Reference logs as streams: windows, sessions, annotation by a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream; its schema is that of the file, never inferred from data."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # event times without a zone are UTC here, as the session is
    return spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream yields from what is there now, as a table in the shared folder.

    Append mode writes files with a commit log; complete mode writes a table of its own for each batch, of which the last is read, so that a batch that
    fails leaves the one before it; update mode adds each batch's changes, a repeated batch taking the place of its first try.
    """
    spark = stream.sparkSession
    target, state = shared_path(spark), shared_path(spark)
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        paths: list[str] = []

        def write(batch: DataFrame, number: int) -> None:
            path = f"{target}/{number}"
            batch.write.mode("overwrite").parquet(path)
            if path not in paths:
                paths.append(path)

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(target)
    kept = paths[-1:] if mode == "complete" else paths
    return spark.read.schema(stream.schema).parquet(*kept) if kept else spark.createDataFrame([], stream.schema)


def windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(begin, action, n, total): counts and sums in tumbling windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), F.col("event_type").alias("action"))
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")).select(F.unix_timestamp("window.start").alias("begin"), "action", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(ref, begin, n): sessions of a reference's entries that no gap splits; for streams and tables alike."""
    grouped = events.groupBy(F.col("user_id").alias("ref"), F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("ref", F.unix_timestamp("w.start").alias("begin"), "n")


def annotated(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a static table, row by row."""
    return events.join(static, on, "left")


def running_values(events: DataFrame) -> DataFrame:
    """(ref, n, last_id): state kept for each reference, told anew with every batch that touches it.

    State is one row a reference: its number of entries and the newest of them by (time, id).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        n, at, last = state.get if state.exists else (0, -1, -1)
        for frame in frames:
            n += len(frame)
            newest = max(zip(frame["ts"].tolist(), frame["event_id"].tolist(), strict=True))
            at, last = max((at, last), newest)
        state.update((n, at, last))
        yield pd.DataFrame({"ref": [key[0]], "n": [n], "last_id": [last]})

    rows = events.select(F.col("user_id").alias("ref"), "event_id", F.unix_micros("ts").alias("ts"))
    return rows.groupBy("ref").applyInPandasWithState(step, "ref long, n long, last_id long", "n long, at long, last long", "update", GroupStateTimeout.NoTimeout)
