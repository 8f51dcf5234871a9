"""Mixing sources to target weights by Pfair scheduling.

The corpus is cut into blocks of a fixed number of characters per source, and a slot of the mixed stream takes one block.
In the exact mix each source holds its weight's share of every slot, and when a source runs out the others go on in
proportion: after a time v a source of weight w and n blocks has had min(v w, n) blocks, and T(v), their sum, is a slot.
Block i is released at slot floor(T(i / w)) and due by slot ceil(T((i + 1) / w)). The exact mix itself is a fractional
schedule within these windows, so a whole one exists, and earliest deadline first finds it: at each slot every source is
less than one block away from its exact share, for any weights, however small, and any number of sources.

One task makes the schedule, a slab of slots after the other: it holds numbers per source and yields a row per block.
With a given ``period``, target weights are first rounded to integer shares q of that many slots, at least 1 each; one
period's pattern then serves all periods, and a last one spreads what the scarcest source has left.

Places within a source follow a hash of doc_id. Running totals of characters are made in two steps (totals of the shards
of a source, then within a shard), so a source that holds a third of all rows is no single task. Only numbers per source
(a number, its blocks and its weight) visit the driver, and with a given period their names as well.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut

#: Characters in a block, slots in a period where shares are asked for (more if there are more sources).
BLOCK = 1 << 15
PERIOD = 1000
#: Slots whose blocks the exact schedule releases together.
SLAB = 1 << 16
#: Target weights default to the sources' sizes to this power, normalised.
TEMPERATURE = 0.5
#: With a given period, more sources than this are refused: its plan has a row per phase and source.
MOST_SOURCES = 2_000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Integer shares that add up to the period, by largest remainder, each at least 1."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for k in range(period - sum(out.values())):
        out[order[k % len(order)]] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -math.inf, s))] -= 1
    return out


def edf(share: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block) of one period: earliest deadline first among the released blocks."""
    period = sum(share.values())
    jobs = sorted((i * period // q, -(-(i + 1) * period // q), s, i) for s, q in share.items() for i in range(q))
    ready: list[tuple[int, str, int]] = []
    out, k = [], 0
    for slot in range(period):
        while k < len(jobs) and jobs[k][0] <= slot:
            heapq.heappush(ready, jobs[k][1:])
            k += 1
        due, source, block = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out.append((slot, source, block))
    return out


def exact(blocks: np.ndarray, weight: np.ndarray, slab: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, block, slot) of all blocks in the order of slots, in parts; sources are places in the two arrays."""
    blocks, weight = np.asarray(blocks, np.int64), np.asarray(weight, np.float64)
    weight = weight / weight.sum()
    # T is linear between the times at which sources run out
    ends = blocks / weight
    order = np.argsort(ends, kind="stable")
    times = np.concatenate(([0.0], ends[order]))
    alive = np.cumsum(weight[order][::-1])[::-1]
    slots = np.concatenate(([0.0], np.cumsum(np.diff(times) * alive)))
    total, slot, taken = int(blocks.sum()), 0, np.zeros(len(blocks), np.int64)
    ready: list[tuple[int, int, int]] = []
    for start in range(0, total, slab):
        stop = min(start + slab, total)
        upto = np.ceil(np.interp(stop, slots, times) * weight).astype(np.int64)
        upto = blocks if stop == total else np.clip(upto, taken, blocks)
        n = upto - taken
        source = np.repeat(np.arange(len(n)), n)
        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + taken[source]
        taken = upto
        # times that are whole slots but for rounding count as whole
        near = 1e-12 * total + 1e-9
        release = np.floor(np.interp(block / weight[source], times, slots) + near).astype(np.int64)
        due = np.ceil(np.interp((block + 1) / weight[source], times, slots) - near).astype(np.int64)
        by = np.argsort(release, kind="stable")
        jobs = list(zip(due[by].tolist(), source[by].tolist(), block[by].tolist(), strict=True))
        releases, k, out = release[by].tolist(), 0, []
        while slot < stop and (ready or k < len(jobs)):
            while k < len(jobs) and (releases[k] <= slot or not ready):
                heapq.heappush(ready, jobs[k])
                k += 1
            _, s, i = heapq.heappop(ready)
            out.append((s, i, slot))
            slot += 1
        for job in jobs[k:]:
            heapq.heappush(ready, job)
        if out:
            yield tuple(np.array(out, np.int64).T)


def phases(blocks: dict[str, int], share: dict[str, int]) -> list[dict]:
    """One row per phase and source: phase, source, share, first_block, n_blocks, first_slot, period.

    A phase repeats one period until its scarcest source has less than its share left; a phase of one period follows for
    what is left of it. There are at most two phases for each source.
    """
    left, done, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while left := {s: n for s, n in left.items() if n}:
        times = min(n // share[s] for s, n in left.items())
        own = {s: share[s] for s in left} if times else {s: min(share[s], n) for s, n in left.items()}
        times = max(1, times)
        period, number = sum(own.values()), len(out) and out[-1]["phase"] + 1
        for s, q in own.items():
            out.append(
                {"phase": number, "source": s, "share": q, "first_block": done[s], "n_blocks": q * times, "first_slot": slot, "period": period}
            )
            done[s] += q * times
            left[s] -= q * times
        slot += period * times
    return out


def _patterns(plan: DataFrame) -> DataFrame:
    """(phase, source, turn, at): the slot within the period of each source's blocks; one task works on one phase."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        found = edf(dict(zip(rows["source"], rows["share"].astype(int), strict=True)))
        out = pd.DataFrame(found, columns=["at", "source", "turn"])
        out["phase"] = rows["phase"].iloc[0]
        return out[["phase", "source", "turn", "at"]]

    return plan.groupBy("phase").applyInPandas(place, "phase long, source string, turn long, at long")


def _small(df: DataFrame) -> DataFrame:
    """Sent to every task if its checked size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _exact_slots(sums: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame:
    """(source, block, slot) of all blocks in the mix of exact weights."""
    spark = sums.sparkSession
    totals = sums.groupBy("source").agg(F.sum("chars").alias("chars"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow("chars", F.lit(TEMPERATURE)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, weight double")
        totals = totals.join(given, "source")
    totals = totals.withColumn("blocks", F.ceil(F.col("chars") / block).cast("long"))
    # numbers in the order of names, however the sources are dealt out
    named = totals.repartitionByRange("source").sortWithinPartitions("source")
    named = cut(named.select("source", "blocks", "weight", F.monotonically_increasing_id().alias("number")))
    own = named.select("number", "blocks", "weight").toPandas().sort_values("number")
    number, blocks, weight = (own[c].to_numpy() for c in ("number", "blocks", "weight"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(number):
                for source, taken, slot in exact(blocks, weight):
                    columns = [pa.array(number[source]), pa.array(taken), pa.array(slot)]
                    yield pa.RecordBatch.from_arrays(columns, ["number", "block", "slot"])

    slots = spark.range(0, 1, 1, 1).mapInArrow(place, "number long, block long, slot long")
    return cut(slots.join(_small(named.select("number", "source")), "number").select("source", "block", "slot"))


def _period_slots(placed: DataFrame, sums: DataFrame, weights: dict[str, float] | None, block: int, period: int) -> DataFrame:
    """placed with the slot of each row's block in the mix of integer shares of a period."""
    spark = sums.sparkSession
    totals = {r["source"]: r["chars"] for r in sums.groupBy("source").agg(F.sum("chars").alias("chars")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    target = {s: n**TEMPERATURE for s, n in totals.items()} if weights is None else {s: weights[s] for s in totals if weights.get(s, 0) > 0}
    blocks = {s: -(-totals[s] // block) for s in target}
    plan = spark.createDataFrame(
        [tuple(p.values()) for p in phases(blocks, shares(target, period))] if target else [],
        "phase long, source string, share long, first_block long, n_blocks long, first_slot long, period long",
    )
    patterns = cut(_patterns(plan.select("phase", "source", "share")))
    placed = placed.join(_small(cut(plan)), "source").where("block >= first_block and block < first_block + n_blocks")
    index = F.col("block") - F.col("first_block")
    placed = placed.withColumn("turn", F.pmod(index, F.col("share"))).withColumn("round", F.floor(index / F.col("share")))
    placed = placed.join(_small(patterns), ["phase", "source", "turn"])
    return placed.withColumn("slot", F.col("first_slot") + F.col("round") * F.col("period") + F.col("at"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """docs with all its columns and, for each row, block (number within its source), slot (of the block in the mixed
    stream) and place (order within the block). A document belongs to the block in which it starts.

    weights: target weight by source; sources that it lacks or gives no positive weight are left out of the mix. Without
    it, weights are the sources' characters to the power TEMPERATURE. period: slots of which weights are rounded to
    integer shares; without it weights count as they are. A null source is the source ``""``; empty and null texts count
    one character; repeated rows are placed each; columns of docs named like a result give way to it. An empty table gives
    an empty result.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.greatest(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)), F.lit(1)).cast("long").alias("chars"),
        F.col("doc_id").alias("id"),
    ).withColumn("key", F.xxhash64("id"))
    sized = rows.select("source", "chars", "key")
    shards = math.isqrt(sized.count()) + 1
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    sums = cut(sized.groupBy("source", shard).agg(F.sum("chars").alias("chars")))

    by_shard = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "shard", F.coalesce(F.sum("chars").over(by_shard), F.lit(0)).alias("before"))
    # the offset of its shard travels with one row of each shard, so that the documents need no join for it
    within = Window.partitionBy("source", "shard").orderBy(F.desc("lead"), "key", "id", "chars", F.xxhash64("doc.text"))
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    empty = F.lit(None)
    heads = before.select(
        empty.cast(rows.schema["doc"].dataType).alias("doc"),
        "source",
        F.col("before").alias("chars"),
        empty.cast(rows.schema["id"].dataType).alias("id"),
        empty.cast("long").alias("key"),
        "shard",
        F.lit(1).alias("lead"),
    )
    placed = rows.withColumn("shard", shard).withColumn("lead", F.lit(0)).unionByName(heads)
    placed = placed.withColumn("start", F.sum("chars").over(running)).withColumn("rank", F.row_number().over(within))
    placed = placed.where("lead = 0").withColumn("block", F.floor(F.col("start") / block))
    if period is None:
        placed = placed.join(_small(_exact_slots(sums, weights, block)), ["source", "block"])
    else:
        placed = _period_slots(placed, sums, weights, block, period)
    # within a block: by shard, then by rank, as one number
    place = F.col("start") - F.col("block") * block
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("block", "slot", "place")]
    return placed.select(*kept, F.col("block").cast("long"), F.col("slot").cast("long"), place.cast("long").alias("place"))


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, slot and place of every document in the mix."""
    return mix(docs, weights).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "block", "slot", "place")
