"""Bootstraps whose draws are weights: each row or cluster counts a Poisson(1) number of times in a draw.

The number follows from the id and the draw by integer arithmetic alone (``weights``; ``drawn_sql`` states it in SQL), so tasks
need no shared state, a lost task gives the same draws again, and any engine can repeat them. Draws agree in distribution
with resampling rows with replacement. No group, cluster or arm is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, written
from .events import linear_percentile

DRAWS, SEED = 200, 20260730
#: The modulus of the arithmetic (a Mersenne prime), and where the number of times changes: P(X <= k) of Poisson(1).
MODULUS = (1 << 31) - 1
STEPS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
#: Draws that a task weighs at once.
SLICE = 20
#: Rows of a range of values that a task weighs together.
BLOCK = 20_000


def weights(ids: np.ndarray, draws: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A row for each id, a column for each draw: how often the id counts in the draw."""
    p = np.int64(MODULUS)
    x = (np.asarray(ids, np.int64) % p)[:, None]
    t = np.asarray(draws, np.int64)[None, :]
    a = (x * 48271 + t * 40692 + seed) % p
    b = (a * a + x) % p
    c = (b * b + a * 16807 + t) % p
    d = (c * c + b) % p
    return np.searchsorted(STEPS, d / float(MODULUS), "right")


def drawn_sql(rows: str, key: str, draws: int = DRAWS, seed: int = SEED) -> str:
    """DuckDB: the rows of a table for each draw, with ``draw`` and ``w``, how often the row counts in it."""
    out = f"select *, (({key}) % {MODULUS} + {MODULUS}) % {MODULUS} as x from {rows}, range({draws}) t(draw)"
    for step in (f"(x * 48271 + draw * 40692 + {seed}) as a", "(a * a + x) as b", "(b * b + a * 16807 + draw) as c", "(c * c + b) as d"):
        value, name = step.split(" as ")
        out = f"select *, {value} % {MODULUS} as {name} from ({out})"
    times = " + ".join(f"case when d / {MODULUS}::double >= {p}::double then 1 else 0 end" for p in STEPS)
    return f"(select * exclude (x, a, b, c, d), {times} as w from ({out}))"


def _weighed(rows: DataFrame, sums: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, sums): for each draw the weighted sums of columns of rows (id, sums)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(sums)))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            for k in range(0, draws, SLICE):
                own = np.arange(k, min(k + SLICE, draws))
                total[own] += weights(ids, own, seed).T @ values
        columns = {"draw": pa.array(np.arange(draws, dtype=np.int64)), **{s: pa.array(total[:, j]) for j, s in enumerate(sums)}}
        yield pa.RecordBatch.from_pydict(columns)

    kind = "draw long, " + ", ".join(f"{s} double" for s in sums)
    parts = rows.select("id", *[F.col(s).cast("double") for s in sums]).mapInArrow(weigh, kind)
    return parts.groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])


def interval(draws: DataFrame, value: str, group: list[str], digits: int = 6) -> DataFrame:
    """(group, draws, low, high): the middle 95 percent, interpolated between draws; rows are draws, so they are bounded."""
    return draws.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("draws"),
        F.round(F.percentile(value, F.lit(0.025)), digits).alias("low"),
        F.round(F.percentile(value, F.lit(0.975)), digits).alias("high"),
    )


def mean_lift(rows: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row (draws, low, high, lift): by how much the mean of the treated exceeds the control's, in parts of it.

    rows: id long, treated boolean, value double; rows with a null do not count. Draws in which an arm has no row, or the
    control sums up to 0, do not count either.
    """
    full = rows.where("id is not null and value is not null and treated is not null")
    arm = {"t": F.col("treated").cast("double"), "c": (~F.col("treated")).cast("double")}
    full = full.select("id", *[(w * F.col("value")).alias(f"{a}_sum") for a, w in arm.items()], *[w.alias(f"{a}_n") for a, w in arm.items()])
    sums = ["t_sum", "c_sum", "t_n", "c_n"]
    lift = (F.col("t_sum") / F.col("t_n")) / (F.col("c_sum") / F.col("c_n")) - 1
    drawn = _weighed(full, sums, draws, seed).where("t_n > 0 and c_n > 0 and c_sum <> 0").select(lift.alias("lift"))
    point = full.agg(*[F.sum(s).alias(s) for s in sums]).select(F.round(F.when((F.col("c_sum") != 0) & (F.col("t_n") > 0), lift), 6).alias("lift"))
    return interval(drawn, "lift", []).crossJoin(point)


def cluster_difference(rows: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row for pairs of arms in clusters: rates of both arms and their difference, its interval, and won and lost clusters.

    rows: cluster long, control_hits, control_n, treatment_hits, treatment_n. Rows of a cluster are not independent, so a draw
    takes clusters, as often as their weight says; rows are added up by cluster first. A cluster is won where the
    treatment's rate is higher; one without trials in an arm is none of the three. Rows without cluster do not count.
    """
    sums = ["control_hits", "control_n", "treatment_hits", "treatment_n"]
    clusters = rows.where("cluster is not null").groupBy(F.col("cluster").alias("id")).agg(*[F.sum(s).cast("double").alias(s) for s in sums])
    clusters = cut(clusters)

    def rate(arm: str):
        return F.when(F.col(f"{arm}_n") > 0, F.col(f"{arm}_hits") / F.col(f"{arm}_n"))

    difference = rate("treatment") - rate("control")
    drawn = _weighed(clusters, sums, draws, seed).select(difference.alias("difference"))
    won = F.signum(F.col("treatment_hits") * F.col("control_n") - F.col("control_hits") * F.col("treatment_n"))
    judged = won.isNotNull() & (F.col("control_n") > 0) & (F.col("treatment_n") > 0)
    whole = clusters.agg(
        F.count("*").alias("clusters"),
        F.count_if(judged & (won > 0)).alias("wins"),
        F.count_if(judged & (won < 0)).alias("losses"),
        F.count_if(judged & (won == 0)).alias("ties"),
        *[F.sum(s).alias(s) for s in sums],
    )
    whole = whole.select("clusters", "wins", "losses", "ties", *[F.round(rate(a), 6).alias(a) for a in ("control", "treatment")], F.round(difference, 6).alias("difference"))
    return whole.crossJoin(interval(drawn, "difference", []))


def median_reduction(rows: DataFrame, group: str, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(group, reduction_pct, low_pct, high_pct, draws): by how much the routed median lies below the held-out one.

    rows: id long, group, arm (routed or holdout), value. Rows are dealt out by range of value, and a range is numbered in
    blocks of so many rows; totals of the draws per block tell where in which block the median of a draw lies, so each median
    is exact, neither an arm nor a frequent value is one task, and a task weighs one block at a time. Draws with a held-out median of 0 do not count, and fewer than half of all draws give no interval; a
    group without rows in both arms, or with a held-out median of 0, has nulls.
    """
    full = rows.where(F.col("arm").isin("routed", "holdout") & F.col("value").isNotNull() & F.col("id").isNotNull())
    full = full.select(F.col("id").cast("long"), group, "arm", F.col("value").cast("double"))
    ranged = full.repartitionByRange(group, "arm", "value", "id").withColumn("range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(group, "arm", "range").orderBy("value", "id"))
    ranged = written(ranged.withColumn("block", F.floor((place - 1) / block).cast("int")))
    key = [group, "arm", "range", "block"]
    kind = {c: ranged.schema[c].dataType.simpleString() for c in key}

    def total(part: pd.DataFrame) -> pd.DataFrame:
        n = np.concatenate([weights(part["id"].to_numpy(), np.arange(k, min(k + SLICE, draws)), seed).sum(0) for k in range(0, draws, SLICE)])
        return pd.DataFrame({**{c: [part[c].iloc[0]] * draws for c in key}, "draw": np.arange(draws), "n": n})

    totals = cut(ranged.groupBy(*key).applyInPandas(total, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", draw long, n long"))
    upto = Window.partitionBy(group, "arm", "draw").orderBy("range", "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(group, "arm", "draw")))
    # of n values in order the median is the mean of those at the places (n - 1) / 2 and n / 2, rounded down
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    asked = totals.where("all > 0").select(*key, "draw", "before", "n", F.explode(F.array(low, high)).alias("place"))
    asked = asked.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).withColumn("place", (F.col("place") - F.col("before")).cast("long"))
    asked = cut(asked.select(*key, "draw", "place"))

    def look_up(both: pd.DataFrame) -> pd.DataFrame:
        wanted, part = both[both["draw"] >= 0], both[both["draw"] < 0].sort_values(["value", "id"])
        ids, values, out = part["id"].to_numpy(), part["value"].to_numpy(), np.zeros(len(wanted))
        drawn, place = wanted["draw"].to_numpy(), wanted["place"].to_numpy()
        for k in range(0, draws, SLICE):
            own = np.arange(k, min(k + SLICE, draws))
            sums = np.cumsum(weights(ids, own, seed), 0)
            for j in np.flatnonzero((drawn >= k) & (drawn < k + SLICE)):
                out[j] = values[np.searchsorted(sums[:, drawn[j] - k], place[j], "right")]
        return pd.DataFrame({group: [both[group].iloc[0]] * len(out), "arm": [both["arm"].iloc[0]] * len(out), "draw": drawn, "value": out})

    # rows and what is asked of them meet as one table: Spark 4.1 fails on cogroups of more than one Arrow batch
    blank = F.lit(0).cast("long")
    same = reduce(lambda x, y: x & y, [ranged[c].eqNullSafe(asked[c]) for c in key])
    rows_asked = ranged.join(asked.select(*key).distinct(), same, "left_semi").select(*key, "id", "value", F.lit(-1).cast("long").alias("draw"), blank.alias("place"))
    both = rows_asked.unionByName(asked.select(*key, blank.alias("id"), F.lit(0.0).alias("value"), "draw", "place"))
    found = both.groupBy(*key).applyInPandas(look_up, f"{group} {kind[group]}, arm string, draw long, value double")
    arm = {a: F.avg(F.when(F.col("arm") == a, F.col("value"))).alias(a) for a in ("routed", "holdout")}
    reduction = F.when(F.col("holdout") != 0, (F.col("holdout") - F.col("routed")) / F.col("holdout") * 100)
    drawn = found.groupBy(group, "draw").agg(*arm.values()).select(group, reduction.alias("reduction"))
    medians = linear_percentile(full, [group, "arm"], "value", 0.5, "value").groupBy(group).agg(*arm.values())
    point = medians.select(group, F.round(reduction, 1).alias("reduction_pct"))
    bounds = interval(drawn, "reduction", [group], 1).where(F.col("draws") * 2 >= draws)
    out = rows.select(group).distinct().join(point, group, "left").join(bounds.select(group, F.col("low").alias("low_pct"), F.col("high").alias("high_pct"), "draws"), group, "left")
    known = F.col("reduction_pct").isNotNull()
    return out.select(group, "reduction_pct", *[F.when(known, F.col(c)).alias(c) for c in ("low_pct", "high_pct", "draws")])
