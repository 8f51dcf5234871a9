"""How filters interact: what each removes, in every order of them, by part of the corpus.

Copies are found by a sort. Rows are dealt out by range of (fingerprint, doc_id) and sorted in each task by fingerprint, full
text and doc_id, and each row is compared with the one before it. A group of copies may lie across tasks: then its
fingerprint is the first or the last of a task, so each task hands on the texts of those two with their smallest doc_id,
and the first rows of a task are held against that. No group is gathered, and a text is compared as a whole.

In the same pass the other filters are decided. What is left of a document is its part and the mask of filters it
fails; masks are counted by part, with the labels, and the counters of a part are sums that tasks make in parts. Every
figure of all 120 orders follows from the at most 32 counters of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

#: The filters by letter; the mask of a document has bit k where it fails the k-th.
FILTERS = "ABCDE"
#: Fixed values of the conditions: words, percent of distinct words, percent of capitals, marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"


def text_mask(raw: bytes, points: int) -> int:
    """The filters A to D that a text of so many code points fails."""
    words = raw.split()
    mask = int(len(words) < LEAST_WORDS)
    if 100 * len(set(words)) < LEAST_DISTINCT * len(words):
        mask |= 2
    letters = np.frombuffer(raw, np.uint8)
    if 100 * int(((letters >= 65) & (letters <= 90)).sum()) > MOST_CAPITALS * points:
        mask |= 4
    return mask


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, mask, edge) of sorted rows, and a row without a mask for each text at the edges of the task.

    edge: the digest of the text, where an earlier task may hold a copy.
    """
    first = last = None  # fingerprints of the task's first row and of the row before
    seen: list[list] = []  # [text, smallest doc_id] of the texts with the current fingerprint; the last is the current text

    def marks() -> pa.RecordBatch:
        n = len(seen)
        columns = [pa.nulls(n, pa.string()), pa.array([x[1] for x in seen], pa.int64()), pa.nulls(n, pa.int32())]
        edges = pa.array([hashlib.sha256(x[0]).digest() for x in seen], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, edges], ["part", "doc_id", "mask", "edge"])

    for batch in batches:
        part, doc_ids, prints, text = batch.columns
        points, marked = pc.utf8_length(text).to_pylist(), pc.match_substring_regex(text, MARKS).to_pylist()
        masks, edges = [], []
        rows = zip(doc_ids.to_pylist(), prints.to_pylist(), text.cast(pa.binary()), points, marked, strict=True)
        for doc_id, fingerprint, raw, n, has_mark in rows:
            raw = raw.as_py()
            if fingerprint != last:
                if last is not None and last == first:
                    yield marks()
                first, last, seen = fingerprint if first is None else first, fingerprint, []
            if not seen or seen[-1][0] != raw:
                seen.append([raw, None])
            least = seen[-1][1]
            copy = least is not None and doc_id > least
            if least is None:
                seen[-1][1] = doc_id
            masks.append(text_mask(raw, n) | 8 * has_mark | 16 * copy)
            edges.append(hashlib.sha256(raw).digest() if fingerprint == first and doc_id is not None and not copy else None)
        yield pa.RecordBatch.from_arrays([part, doc_ids, pa.array(masks, pa.int32()), pa.array(edges, pa.binary())], ["part", "doc_id", "mask", "edge"])
    if last is not None:
        yield marks()


def failure_masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, doc_id, mask) of every document: its source and the filters it fails.

    Null texts and sources are empty. E fails a row if a row with a smaller doc_id has the same text; of rows that agree in
    doc_id and text none fails for the others, and a null doc_id is neither smaller nor larger than any.
    """
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("long"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fingerprint"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    rows = scratch.written(rows.mapInArrow(_decided, "part string, doc_id long, mask int, edge binary"))
    # two texts a task, unless fingerprints collide
    edges = rows.where("mask is null").groupBy("edge").agg(F.min("doc_id").alias("least"))
    rows = rows.where("mask is not null").join(F.broadcast(edges) if edges.count() <= BROADCAST_ROWS // 4 else edges, "edge", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.select("part", "doc_id", F.when(copy, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counters): for each mask in a part how many documents have it, and how many of them are good and toxic.

    A document counts as good or toxic if any row of labels says so.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    own = masks.join(said, "doc_id", "left").groupBy("part", "mask")
    own = own.agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return own.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))


def filter_audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each part, order of the filters and step in it: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    An empty table gives no rows. Further columns are not read; texts of any length are compared and counted whole.
    """
    counters = part_counters(failure_masks(docs, scratch or Scratch(docs.sparkSession)), labels)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))

    def bit(k: Column | str) -> Column:
        return F.expr(f"shiftleft(1, ascii(substr(filter_order, {k}, 1)) - {ord(FILTERS[0])})")

    rows = rows.withColumn("own", bit("step"))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(F.substr("filter_order", k, F.lit(1))) - ord(FILTERS[0]))))
    rows = rows.withColumn("upto", before).withColumn("before", F.col("upto") - F.col("own"))

    def total(value: str, where) -> Column:
        return F.aggregate("counters", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[value]).otherwise(F.lit(0)))

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(F.col("before")) == 0) & (m.bitwiseAND(F.col("own")) != 0)

    # of a document's k failed filters each is the first one in 120 / k orders
    share = F.aggregate(
        "counters",
        F.lit(0).cast("long"),
        lambda a, c: a + F.when(c["mask"].bitwiseAND(F.col("own")) != 0, F.call_function("div", c["n"] * 120, F.bit_count(c["mask"]).cast("long"))).otherwise(F.lit(0)),
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(F.col("upto")) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(F.col("before")) != 0) & (m.bitwiseAND(F.col("own")) != 0)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
