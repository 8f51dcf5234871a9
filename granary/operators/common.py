"""Lineage cuts, sized broadcasts, distributed ranks and previous rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a broadcast table may have; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Settings of Arrow batches: their default, and what it is replaced by.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of bounded size (unless it says otherwise), since a row may be a long text, and without
    a plan of Spark 4.1 that gives wrong results.

    That plan takes a union of shuffled tables for partitioned like them and groups without a shuffle, even where adaptive
    execution has coalesced their partitions differently, so that rows of one key stay apart.
    """
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is set and Spark runs on one machine."""
    sc = prepared(spark).sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Larger tables: written as Parquet in the shared folder, so later reads prune columns."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows for Python tasks, dealt out anew where they come from fewer files than there are cores: a small table in one file
    would be one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def sized(df: DataFrame) -> DataFrame:
    """A cut table, marked for broadcast if its counted size allows it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def semi_joined(left: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key is among the distinct ``keys``, which are broadcast if their counted size allows it."""
    return left.join(sized(keys), on, "left_semi")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``position``; tasks keep k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", place).where(F.col("position") <= k)


def order_statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, below, upto): for each distinct value of a group how many rows are below it and how many up to it.

    Values are counted first and then dealt out by range, so that neither a group nor a value is the work of one task;
    only totals per range and group meet.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange(*group, F.col(value)).withColumn("range", F.spark_partition_id()))
    totals = counts.groupBy(*group, "range").agg(F.sum("n").alias("total"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    joined = counts.join(sized(totals), [*group, "range"])
    running = Window.partitionBy(*group, "range").orderBy(value)
    upto = F.col("offset") + F.sum("n").over(running)
    return joined.withColumn("upto", upto).select(*group, value, (F.col("upto") - F.col("n")).alias("below"), "upto")


def value_at(ranked: DataFrame, group: list[str], value: str, index: Column) -> DataFrame:
    """(group, value) at a 0-based place of the sorted group; ``index`` may use ``rows``, the size of the group."""
    sizes = ranked.groupBy(*group).agg(F.max("upto").alias("rows"))
    found = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))
    at = index.cast("long")
    return found.where((F.col("below") <= at) & (at < F.col("upto"))).select(*group, value)


def with_previous(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], shard: Column) -> DataFrame:
    """df with ``prev_<column>`` of the row before in the order (ts, tie) of its key.

    Rows are windowed by key and shard (a part of time, so that a long history is many tasks); the last row of each shard
    is passed on to the next one.
    """
    df = df.withColumn("shard", shard)
    place = F.struct(ts, tie, *columns)
    last = df.groupBy(key, "shard").agg(F.max(place).alias("last"))
    passed = last.withColumn("last", F.lag("last").over(Window.partitionBy(key).orderBy("shard")))
    window = Window.partitionBy(key, "shard").orderBy(ts, tie)
    df = df.withColumn("before", F.lag(place).over(window)).join(passed, [key, "shard"])
    before = F.coalesce(F.col("before"), F.col("last"))
    return df.select("*", *[before[c].alias(f"prev_{c}") for c in [ts, *columns]]).drop("shard", "before", "last")
