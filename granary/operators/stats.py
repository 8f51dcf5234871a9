"""Evaluation statistics: paired outcomes, exact tests, intervals and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import linear_percentile

Z = 1.96


def paired_outcomes(pairs: DataFrame) -> DataFrame:
    """One row of wins, losses and ties of complete pairs (control, treatment)."""
    full = pairs.where("control is not null and treatment is not null")
    return full.agg(
        F.count_if(F.col("treatment") > F.col("control")).alias("wins"),
        F.count_if(F.col("treatment") < F.col("control")).alias("losses"),
        F.count_if(F.col("treatment") == F.col("control")).alias("ties"),
    )


def mcnemar_exact(wins: Column, losses: Column) -> Column:
    """Two-sided exact test of wins against losses.

    The binomial tail is summed in logarithms (log n! as sums of logarithms), so that hundreds of thousands of pairs
    neither overflow nor leave the JVM.
    """
    n, least = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("tail"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (state["tail"] + F.exp(term)).alias("tail"))

    steps = F.when(least > 0, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, add)["tail"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a proportion; null without trials."""
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


def gate_metrics(rows: DataFrame, decision: str, truth: str) -> DataFrame:
    """One row: precision, recall and false-positive rate of a boolean decision; null on an empty denominator."""
    d, t = F.col(decision), F.col(truth)
    hit, wrong, missed, rest = (F.count_if(c) for c in (d & t, d & ~t, ~d & t, ~d & ~t))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 9))

    return rows.agg(
        F.count("*").alias("n"),
        ratio(hit, hit + wrong).alias("precision"),
        ratio(hit, hit + missed).alias("recall"),
        ratio(wrong, wrong + rest).alias("false_positive_rate"),
    )


def regression_gate(before: DataFrame, after: DataFrame, key: str, tolerance: float = 0.25) -> DataFrame:
    """Values (key, value) where higher is worse, before and after: relative change and whether it is a regression."""
    a, b = before.select(key, F.col("value").alias("before")), after.select(key, F.col("value").alias("after"))
    change = F.when(F.col("before") != 0, F.round((F.col("after") - F.col("before")) / F.col("before"), 9))
    both = a.join(b, key, "full").withColumn("change", change)
    return both.withColumn("regressed", F.coalesce(F.col("change") > tolerance, F.lit(False)))


# Metrics of the lift gate, the first with enough samples counts, and what is enough in each arm.
LIFT_METRICS = ["turns", "total_tokens", "tool_calls", "elapsed_seconds"]
LEAST_SAMPLES = 15


def lift_gate(rows: DataFrame, group: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """(group, metric, routed_samples, holdout_samples, reduction_pct): by how much the routed median lies below the other.

    rows: group, arm (routed or holdout) and a column per metric. Each group is judged by the first metric with ``least``
    samples in both arms and a held-out median other than 0; groups without one have nulls. Medians are exact and gather
    no group.
    """
    known = rows.where(F.col("arm").isin("routed", "holdout"))
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(m).cast("double").alias("value")) for k, m in enumerate(LIFT_METRICS)])
    long = known.select(group, "arm", F.explode(pairs).alias("p")).select(group, "arm", "p.*").where("value is not null")
    key = [group, "rank", "arm"]
    medians = linear_percentile(long, key, "value", 0.5, "median").join(long.groupBy(*key).agg(F.count("*").alias("n")), key)
    arm = {a: [F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for c in ("median", "n")] for a in ("routed", "holdout")}
    both = medians.groupBy(group, "rank").agg(*arm["routed"], *arm["holdout"])
    both = both.where((F.col("routed_n") >= least) & (F.col("holdout_n") >= least) & (F.col("holdout_median") != 0))
    first = both.groupBy(group).agg(F.min(F.struct("rank", "routed_median", "holdout_median", "routed_n", "holdout_n")).alias("f"))
    lift = (F.col("f.holdout_median") - F.col("f.routed_median")) / F.col("f.holdout_median") * 100
    out = rows.select(group).distinct().join(first, group, "left")
    return out.select(
        group,
        F.element_at(F.array(*[F.lit(m) for m in LIFT_METRICS]), F.col("f.rank") + 1).alias("metric"),
        F.col("f.routed_n").alias("routed_samples"),
        F.col("f.holdout_n").alias("holdout_samples"),
        F.round(lift, 1).alias("reduction_pct"),
    )
