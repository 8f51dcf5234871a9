"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import shared_folder
from .state import SETTINGS


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, event_type, n, total) by tumbling window; events later than ``late`` are dropped from closed windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated_events(events: DataFrame, late: str) -> DataFrame:
    """Each event_id once within the watermark."""
    out = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return out.select("event_id", "ts", "user_id", "event_type", "value")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start, end, n) of sessions that end after a gap without events."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(
    spark: SparkSession, folder: str, name: str, transform: Callable[[DataFrame], DataFrame], complete: bool = False, files: int | None = None
) -> DataFrame:
    """The result of a query over a table's files read as a stream, ``files`` at a time, until all are consumed.

    The stream has a session of its own, so that the caller's settings stay as they are.
    Each micro-batch replaces a table in the shared folder (complete) or is a folder of it (append), so a batch that is
    tried again replaces what it wrote before.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # one file or a folder of them: a stream reads folders, so a single file is picked by its name
    own = spark.newSession()
    for key, value in {**SETTINGS, "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        own.conf.set(key, value)
    source = own.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if _is_file(spark, path) else "*.parquet")
    source = source.option("maxFilesPerTrigger", files) if files else source
    events = source.parquet(folder if _is_file(spark, path) else path)
    rows = transform(events.withColumn("ts", F.col("ts").cast("timestamp")))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if complete else f"{out}/rows/batch={number}")

    query = (
        rows.writeStream.outputMode("complete" if complete else "append")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(rows.columns)


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
