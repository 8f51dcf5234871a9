"""Lineage cuts, sized broadcasts and connected components shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import prepared

#: Rows of two longs that one broadcast may hold (32 MB); larger sides are shuffled.
BROADCAST_ROWS = 2_000_000
#: Edges of a graph that one task holds while components are found.
EDGES_PER_TASK = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is set and Spark runs on one machine."""
    sc = ready(spark).sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Small tables: computed once and kept in the shared folder until no longer referenced."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Larger tables: written as Parquet in the shared folder, so later reads prune columns."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder that are needed until ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_path(self.spark))
        return written(df, self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths = []


def ready(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of few rows (unless it says otherwise), since a row may be a long text."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepared(spark)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, two independent hashes (h, g) of the text, and text: rows that agree in all have the same doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), "text")


def rows_that_stay(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs, with all its columns, after decisions (doc_id, h, g, kept) on its rows: of rows with equal doc_id and text, which
    are as good as one, one stays if any was kept, and none otherwise. Rows without a decision stay.
    """
    keys = decided.groupBy("doc_id", "h", "g").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = cut(keys.where("not kept or n > 1"))
    gone, repeated = keys.where("not kept"), keys.where("kept")
    text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("long")

    def joined(left: DataFrame, side: DataFrame, how: str) -> DataFrame:
        same = doc_id.eqNullSafe(side["doc_id"]) & (F.xxhash64(text) == side["h"]) & (F.hash(text) == side["g"])
        return left.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS // 2 else side, same, how)

    out = joined(docs, gone, "left_anti")
    if repeated.isEmpty():
        return out
    one = joined(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return joined(out, repeated, "left_anti").unionByName(one)


def semi_join_sized(left: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Left rows whose key is in ``keys`` (a cut table of distinct keys), or with left_anti those whose key is not.

    The keys are counted; up to BROADCAST_ROWS they are broadcast, beyond that both sides are shuffled.
    """
    if keys.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(keys), on, how)
    return left.join(keys.hint("merge"), on, how)


def merged_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the graph with these labels (node, label) and more ``edges`` (a, b)."""
    return connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(edges))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) contracted: each node once, with the smallest node that the task's edges connect it to."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_pydict(
        {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}
    )


def _contracted(edges: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The forests of the edges, with as many tasks as so many rows need."""
    tasks = rows // EDGES_PER_TASK + 1
    return cut(edges.coalesce(tasks).mapInArrow(_forests, "u long, v long")), tasks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over undirected ``edges`` (a, b).

    Each task first contracts the edges it holds, at most about EDGES_PER_TASK. Where more than one task is needed,
    the large-star and small-star steps (Kiveris et al. 2014) alternate until the edge set stays the same. Each step
    reads a node's neighbours only through a minimum, so hubs are pre-aggregated and never gathered.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    state, tasks = _contracted(state, state.count())
    seen = None
    while tasks > 1:
        mark = state.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == seen:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = low.select("u", F.col("m").alias("v"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(kept.unionByName(moved).where("u <> v").distinct())
    return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
