"""Access counters as a stream: deltas per key with a watermark, merged exactly once per batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workspace


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream; the schema is taken from the files once."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema)
    # a single file is read as the one entry of its folder that matches the name
    return reader.option("pathGlobFilter", name).parquet(folder) if not _is_dir(spark, path) else reader.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def deltas(events: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, n, last_at): running counts and last access, for update mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(time).alias("last_at"))


def windows(events: DataFrame, key: str = "event_type", time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window, with a watermark; late rows beyond it are dropped by definition."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def merge_batches(events: DataFrame, out: str, key: str = "user_id", time: str = "ts") -> None:
    """Drains the stream into ``out``: each micro-batch is reduced by key and written to a folder of its own number.

    A batch that is repeated after a failure overwrites its own folder, so a delta counts once. The checkpoint lies beside it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n"), F.max(time).alias("last_at")).write.mode("overwrite").parquet(f"{out}/deltas/batch={number}")

    q = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def totals(spark: SparkSession, out: str, key: str = "user_id") -> DataFrame:
    return spark.read.parquet(f"{out}/deltas").groupBy(key).agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def drain(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """All events of a path through the stream, as totals per key."""
    out = workspace(spark, "stream")
    merge_batches(read_events(spark, path), out, key)
    return totals(spark, out, key)


def _drained(rows: DataFrame, out: str, mode: str) -> None:
    """Runs a streaming query over what is there; each micro-batch goes to a folder of its own number, a repeated one overwrites it."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _timed(spark: SparkSession, path: str, time: str) -> DataFrame:
    return read_events(spark, path).withColumn(time, F.col(time).cast("timestamp"))


def drain_windows(spark: SparkSession, path: str, key: str = "event_type", time: str = "ts") -> DataFrame:
    """(start, key, n) of all events of a path through the stream: every batch gives the windows that it changed, the latest counts."""
    out = workspace(spark, "stream")
    _drained(windows(_timed(spark, path, time), key, time), out, "update")
    return spark.read.parquet(f"{out}/rows").groupBy("start", key).agg(F.max_by("n", "batch").alias("n"))


def drain_sessions(spark: SparkSession, path: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(start, end, key, n) of all events of a path through the stream. Open sessions may still merge, so every batch gives the whole
    table and the last one counts."""
    out = workspace(spark, "stream")
    _drained(sessions(_timed(spark, path, time), key, time), out, "complete")
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
