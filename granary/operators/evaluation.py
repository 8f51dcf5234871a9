"""Judging routed results: hits, margins, replicated outcomes, changes between snapshots, and limits per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hit_rates(ranked: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits, queries, rate): queries of which an expected document (query_id, doc_id) is among the first k.

    Every query of ``expected`` counts, also those without a result.
    """
    expected = expected.select("query_id", "doc_id")
    found = expected.join(ranked.select("query_id", "doc_id", "position"), ["query_id", "doc_id"], "left")
    best = found.groupBy("query_id").agg(F.min("position").alias("best"))
    hits = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("best") <= k).alias("hit")) for k in ks])
    rows = best.select("query_id", F.explode(hits).alias("at")).groupBy(F.col("at.k").alias("k"))
    out = rows.agg(F.count_if(F.col("at.hit")).alias("hits"), F.count("*").alias("queries"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("queries"), 9))


def clear_winners(ranked: DataFrame, factor: float = 1.6) -> DataFrame:
    """(query_id, doc_id, margin, clear): the first result of each query, its lead, and whether it is ``factor`` times the next.

    A result without a runner-up is clear and has no margin.
    """
    both = ranked.where("position <= 2").groupBy("query_id").agg(
        F.min(F.struct("position", "doc_id", "score")).alias("top"), F.max(F.when(F.col("position") == 2, F.col("score"))).alias("runner")
    )
    top = F.col("top.score")
    return both.select(
        "query_id",
        F.col("top.doc_id").alias("doc_id"),
        F.round(top - F.col("runner"), 6).alias("margin"),
        F.coalesce(top >= factor * F.col("runner"), F.lit(True)).alias("clear"),
    )


def replicated_tasks(rows: DataFrame, least: int = 2) -> DataFrame:
    """(task, control, treatment, control_n, treatment_n): pass rates by arm of the tasks that can show a difference.

    rows: task, treated boolean, passed boolean. Tasks with fewer than ``least`` replicates in an arm, and those whose
    control always passes, are left out.
    """
    treated, passed = F.col("treated"), F.col("passed").cast("int")
    arms = rows.groupBy("task").agg(
        F.avg(F.when(~treated, passed)).alias("control"),
        F.avg(F.when(treated, passed)).alias("treatment"),
        F.count_if(~treated).alias("control_n"),
        F.count_if(treated).alias("treatment_n"),
    )
    return arms.where((F.col("control_n") >= least) & (F.col("treatment_n") >= least) & (F.col("control") < 1))


def behaviour_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, changed) for the keys of either snapshot; a missing key differs from any value."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def within_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with ``recent``: how many events of the key lie in the ``seconds`` up to and with this one.

    Time is cut in parts of that length and a part also sees the one before it, so that a busy key is many tasks.
    """
    part = F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000))
    copies = F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part + 1).alias("part"), F.lit(False).alias("own")))
    spread = events.select("*", F.unix_micros(F.col(ts)).alias("_at"), F.explode(copies).alias("_in")).select("*", "_in.part", "_in.own")
    span = Window.partitionBy(key, "part").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return spread.withColumn("recent", F.count("*").over(span)).where("own").drop("_at", "_in", "part", "own")


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 9))
